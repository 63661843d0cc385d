"""Streams of document revisions: doc_id, version, ts, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IDLE = "250 milliseconds"
LATE = "1 minute"


def debounce(revisions: DataFrame, idle: str = IDLE, late: str = LATE) -> DataFrame:
    """The last revision of every burst: one row for each run of revisions that are less than ``idle`` apart.

    A session window for each document, closed by the watermark; the same plan runs on a batch, where the
    watermark has no effect.
    """
    rows = revisions.withWatermark("ts", late) if revisions.isStreaming else revisions
    last = rows.groupBy("doc_id", F.session_window("ts", idle).alias("burst")).agg(
        F.max_by(F.struct("version", "ts", "text"), F.struct("ts", "version")).alias("x"), F.count("*").alias("revisions")
    )
    return last.select("doc_id", "x.version", "x.ts", "x.text", "revisions")


def baselines(snapshots: DataFrame) -> DataFrame:
    """First and latest snapshot of each document in a batch: doc_id, before, after (structs of its columns)."""
    item = F.struct(*[c for c in snapshots.columns if c != "doc_id"])
    return snapshots.groupBy("doc_id").agg(F.min_by(item, "version").alias("before"), F.max_by(item, "version").alias("after"))


def evict(states: DataFrame, opened: DataFrame) -> DataFrame:
    """States of documents that are still open."""
    return states.join(opened.select("doc_id").distinct(), "doc_id", "left_semi")
