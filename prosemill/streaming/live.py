"""The analysis of a stream, in one query with keyed state: which revisions are new, and how far each document has moved since its first.

Revisions (doc_id, version, ts, text) are debounced, compared with what the state knows of their document, analysed if their text or the
options changed, and compared with the document's first and latest snapshot. State is a value for each open document in the
state store: a batch touches the documents it has revisions of and no others, and what is not touched for ``ttl`` expires.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from prosemill.operators import measures
from prosemill.plans.engine import ProseEngine
from prosemill.plans.options import RuleOptions
from prosemill.streaming.revisions import debounce

TTL_MS = 7 * 24 * 3600 * 1000
METRICS = [k for k, _, _ in measures.METRICS]
NUMBERS = "array<double>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocks(spark: SparkSession) -> SparkSession:
    """Queries started from now on keep their state in RocksDB, which expiry needs; running and earlier ones keep their own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


class _Known(StatefulProcessor):
    """What kind each revision is: ``first``, ``changed``, ``same`` or ``closed`` (its text is null).

    Known of a document are its last text's hash and the epoch it was analysed in. A ``same`` revision and a closed one go on without text.
    """

    def __init__(self, epoch: str, ttl_ms: int):
        self.epoch, self.ttl_ms = epoch, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "text_hash string, epoch string", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.known.get() if self.known.exists() else None
        out = []
        for row in pd.concat(rows).sort_values(["ts", "version"]).itertuples():
            if row.text is None or row.text != row.text:
                out.append((row.doc_id, row.version, row.ts, "closed", None))
                known = None
                continue
            mine = (hashlib.sha256(row.text.encode()).hexdigest(), self.epoch)
            kind = "first" if known is None else "same" if tuple(known) == mine else "changed"
            out.append((row.doc_id, row.version, row.ts, kind, None if kind == "same" else row.text))
            known = mine
        if known is None:
            self.known.clear()
        else:
            self.known.update(tuple(known))
        yield pd.DataFrame(out, columns=["doc_id", "version", "ts", "kind", "text"])

    def close(self) -> None:
        pass


class _Baselines(StatefulProcessor):
    """First and latest numbers of each document; one row for each revision that was analysed."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ends = handle.getValueState("ends", f"before {NUMBERS}, after {NUMBERS}", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        ends = self.ends.get() if self.ends.exists() else None
        out = []
        for row in pd.concat(rows).sort_values(["ts", "version"]).itertuples():
            if row.kind == "closed":
                ends = None
            elif row.kind != "same":
                now = [float(x) for x in row.numbers]
                before, last = (now, now) if ends is None or row.kind == "first" else ([float(x) for x in side] for side in ends)
                out.append((row.doc_id, row.version, row.ts, row.kind, before, now, now != last))
                ends = (before, now)
        if ends is None:
            self.ends.clear()
        else:
            self.ends.update(tuple([float(x) for x in side] for side in ends))
        yield pd.DataFrame(out, columns=["doc_id", "version", "ts", "kind", "before", "after", "moved"])

    def close(self) -> None:
        pass


def changes(revisions: DataFrame, options: RuleOptions = RuleOptions(), ttl_ms: int = TTL_MS) -> DataFrame:
    """``doc_id, version, ts, kind, text`` of settled revisions: what is new of each.

    The options are the epoch: under others every document is ``changed`` at its next revision, whatever its text. A revision whose text is null
    closes its document, and the next one is a first again, as it is after ``ttl_ms`` without any.
    """
    schema = T.StructType([*[revisions.schema[c] for c in ("doc_id", "version", "ts")], T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())])
    # The key is another one than the bursts', as two state stores of one key would be opened by the same task.
    settled = debounce(revisions).select(F.col("doc_id").cast("string").alias("key"), "doc_id", "version", "ts", "text")
    return settled.groupBy("key").transformWithStateInPandas(_Known(repr(options), ttl_ms), schema, "Append", "ProcessingTime")


def analysed(revisions: DataFrame, options: RuleOptions = RuleOptions(), ttl_ms: int = TTL_MS) -> DataFrame:
    """``doc_id, version, ts, kind, before, after, moved`` of every settled revision whose text or options are new.

    ``before`` has the numbers of the document's first revision and ``after`` those of this one; ``moved`` tells whether they differ from the
    revision before. Start it with ``keep_state_in_rocks``; a query that is started again on its checkpoint goes on with its state. As state
    expires by the clock, batches without data go on for ever, unless ``spark.sql.streaming.noDataMicroBatches.enabled`` is off.
    """
    new = changes(revisions, options, ttl_ms)
    named = new.select(F.struct("doc_id", "version", "ts", "kind").alias("doc_id"), "text")
    shots = ProseEngine(named, options).snapshot.select("doc_id.*", F.array(*METRICS).alias("numbers"))
    schema = T.StructType([new.schema[c] for c in ("doc_id", "version", "ts", "kind")]).add("before", T.ArrayType(T.DoubleType())).add("after", T.ArrayType(T.DoubleType())).add("moved", "boolean")
    found = shots.groupBy("doc_id").transformWithStateInPandas(_Baselines(ttl_ms), schema, "Append", "ProcessingTime")

    def named_numbers(side: str):
        return F.struct(*[F.get(side, F.lit(i)).alias(k) for i, k in enumerate(METRICS)]).alias(side)

    return found.select("doc_id", "version", "ts", "kind", named_numbers("before"), named_numbers("after"), "moved")


def deltas(found: DataFrame) -> DataFrame:
    """The compared metrics of each analysed revision against its document's first, a row for each: no grouping, so it runs on the stream."""
    return measures.change_rows(found, ["doc_id", "version"])
