"""A stream of revisions from files to deltas, with state that survives a restart, new options, closing and expiry."""

import datetime as dt
import time

import pytest

from prosemill.plans.options import RuleOptions
from prosemill.streaming import live

SCHEMA = "doc_id long, version long, ts timestamp, text string"


def at(seconds):
    return dt.datetime(2024, 5, 1) + dt.timedelta(seconds=seconds)


class Feed:
    """Files of revisions and a query over them that can be stopped and started again on its checkpoint."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.clock = live.keep_state_in_rocks(spark), str(folder), 0

    def put(self, rows):
        """Rows, and two later ones of other documents: one to let the watermark pass, one for a batch in which the rows settle."""
        parts = [rows]
        for _ in range(2):
            self.clock = max([self.clock, *(r[2].timestamp() for r in rows)]) + 300
            parts.append([(1000 + int(self.clock), 0, dt.datetime.fromtimestamp(self.clock), None)])
        for part in parts:
            self.spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")

    def run(self, plan, name):
        """Everything in the folder through the plan; what has been put out so far, checkpoint included."""
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/in")
        writer = plan(stream).writeStream.format("parquet").option("checkpointLocation", f"{self.folder}/{name}-c")
        query = writer.trigger(availableNow=True).start(f"{self.folder}/{name}")
        assert query.awaitTermination(120)
        return self.spark.read.parquet(f"{self.folder}/{name}").where("doc_id < 1000").collect()


@pytest.fixture
def feed(spark, tmp_path):
    # Expiry by the clock asks for batches without data for ever; without them a query over given files ends.
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.streaming.noDataMicroBatches.enabled")
    old = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[1], "false")
    yield Feed(spark, tmp_path)
    for n, value in old.items():
        spark.conf.set(n, value)


def test_kinds_across_restarts(feed):
    def kinds(options=RuleOptions(), ttl_ms=live.TTL_MS):
        rows = feed.run(lambda s: live.changes(s, options, ttl_ms), "kinds")
        return {(r["doc_id"], r["version"]): (r["kind"], r["text"]) for r in rows}

    feed.put([(1, 1, at(0), "a"), (1, 2, at(0.1), "ab"), (1, 3, at(9), "ab"), (1, 4, at(20), "abc"), (2, 1, at(0), "x")])
    assert kinds() == {(1, 2): ("first", "ab"), (1, 3): ("same", None), (1, 4): ("changed", "abc"), (2, 1): ("first", "x")}
    feed.put([(1, 5, at(5000), "abc"), (2, 2, at(5000), None), (2, 3, at(5010), "x"), (3, 1, at(5000), "new")])
    second = kinds()
    assert second[1, 5] == ("same", None) and second[2, 2] == ("closed", None) and second[2, 3] == ("first", "x") and second[3, 1] == ("first", "new")
    feed.put([(1, 6, at(9000), "abc"), (3, 2, at(9000), "new")])
    third = kinds(RuleOptions({"passive": False}))
    assert third[1, 6] == ("changed", "abc") and third[3, 2] == ("changed", "new") and len(third) == 10


def test_state_expires(feed):
    def kinds():
        return {(r["doc_id"], r["version"]): r["kind"] for r in feed.run(lambda s: live.changes(s, ttl_ms=2000), "short")}

    feed.put([(1, 1, at(0), "a")])
    assert kinds() == {(1, 1): "first"}
    time.sleep(2.5)
    feed.put([(1, 2, at(5000), "a")])
    assert kinds()[1, 2] == "first"


def test_deltas_of_the_stream(feed):
    def run(options=RuleOptions()):
        return feed.run(lambda s: live.analysed(s, options), "found")

    feed.put([(1, 1, at(0), "The net was torn."), (2, 1, at(0), "Calm.")])
    first = run()
    assert {(r["doc_id"], r["version"], r["moved"]) for r in first} == {(1, 1, False), (2, 1, False)}
    feed.put([(1, 2, at(5000), "Nets."), (1, 3, at(5000.1), "Nets dry slowly."), (2, 2, at(5000), "Calm.")])
    feed.put([(1, 4, at(9000), "Nets dry.")])
    rows = {(r["doc_id"], r["version"]): r for r in run()}
    assert rows.keys() == {(1, 1), (2, 1), (1, 3), (1, 4)}
    assert (rows[1, 3]["before"]["passive"], rows[1, 3]["after"]["passive"], rows[1, 3]["after"]["adverb"]) == (1.0, 0.0, 1.0)
    assert rows[1, 4]["before"]["words"] == 4.0 and rows[1, 4]["after"]["words"] == 2.0 and rows[1, 4]["moved"]
    table = feed.spark.read.parquet(f"{feed.folder}/found")
    got = {(r["version"], r["key"]): (r["delta"], r["better"]) for r in live.deltas(table).where("doc_id = 1").collect()}
    assert got[3, "passive"] == (-1.0, True) and got[3, "adverb"] == (1.0, False) and got[4, "words"] == (-2.0, None)
