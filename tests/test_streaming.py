"""Streams give what the batch gives."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from overstats.operators import state
from overstats.sources import documents
from overstats.sources.tables import Tables
from overstats.streaming import ingest, live
from overstats.operators import publish
from tests.hand import ball, innings, match, save

FOLDER = "/root/testdata/sf0.001"


SCHEMA = "match_id string, innings int, seq int, is_legal int, team_wickets bigint, runs_total bigint, penalty_pre bigint, max_balls int"


def arrive(spark, folder, match, *seqs, limit=120):
    rows = [(match, 1, k, 1, 0, k, 0, limit) for k in seqs]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(folder))


@pytest.fixture
def quiet(spark):
    """No batches without data: with timers they would follow each other without end."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def started(spark, tmp_path, frame, name):
    return frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name))


def test_live_state_equals_batch_with_late_and_repeated_balls(spark, tmp_path, quiet):
    tables = Tables(spark, FOLDER)
    rows = live.feed(tables.mixed, {"t20i": 120, "odi": 300, "test": None})
    folder = tmp_path / "feed"
    late = (F.col("seq") % 7 == 3) & (F.col("match_id").cast("int") % 2 == 0)
    # First file lacks some balls; the second brings them, with repeats.
    rows.where(~late).coalesce(1).write.mode("append").json(str(folder))
    time.sleep(1.1)
    rows.where(late | (F.col("seq") % 11 == 0)).coalesce(1).write.mode("append").json(str(folder))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(str(folder))
    query = started(spark, tmp_path, live.live_states(stream), "live").trigger(availableNow=True).start()
    query.awaitTermination(240)
    cols = ("match_id", "innings", "seq", "balls_left", "wickets", "runs")
    got = {tuple(r) for r in spark.table("live").select(*cols).collect()}
    limit = F.when(F.col("fmt") == "odi", 300).when(F.col("fmt") == "t20i", 120)
    played = tables.mixed.select("match_id", "innings", "seq", limit.alias("limit"))
    batch = state.replay_states(tables.mixed, F.lit(0)).join(played, ["match_id", "innings", "seq"]).withColumns(
        {"match_id": F.col("match_id").cast("string"), "balls_left": F.col("limit") + F.col("balls_left")})
    want = {tuple(r) for r in batch.select(*cols).collect()}
    assert {r for r in got if r[1] <= 2} == want and len({r[3] is None for r in got}) == 2
    assert spark.table("live").count() == len(got)


def test_a_gap_closes_after_a_time_out(spark, tmp_path, quiet):
    folder = tmp_path / "feed"
    arrive(spark, folder, "m", 1, 2, 4, 5)
    frame = live.live_feed(spark.readStream.schema(SCHEMA).json(str(folder)), idle="1 second", patience="1 hour")
    query = started(spark, tmp_path, frame, "gap").start()
    try:
        query.processAllAvailable()
        for other in ("n", "o"):  # batches in which m times out
            time.sleep(2)
            arrive(spark, folder, other, 1)
            query.processAllAvailable()
        arrive(spark, folder, "m", 2, 3, 6)
        query.processAllAvailable()
    finally:
        query.stop()
    got = spark.table("gap").where("match_id = 'm'").collect()
    assert sorted((r.seq, r.balls_left, r.runs) for r in got) == [(1, 119, 1), (2, 118, 3), (3, 117, 6), (4, 116, 10), (5, 115, 15), (6, 114, 21)]
    assert {r.kind for r in got} == {"state"}


def test_what_is_over_goes_and_late_balls_come_out_beside(spark, tmp_path, quiet):
    folder = tmp_path / "feed"
    arrive(spark, folder, "done", 1, 2)
    arrive(spark, folder, "torn", 1, 3, 4, limit=None)
    frame = live.live_feed(spark.readStream.schema(SCHEMA).json(str(folder)), idle="1 second", patience="3 seconds")
    query = started(spark, tmp_path, frame, "over").start()
    try:
        query.processAllAvailable()
        for other in ("n", "o", "p"):
            time.sleep(2)
            arrive(spark, folder, other, 1)
            query.processAllAvailable()
        rows = lambda name: sorted((r.seq, r.balls_left, r.runs, r.kind) for r in spark.table("over").where(f"match_id = '{name}'").collect())
        assert rows("done") == [(1, 119, 1, "state"), (2, 118, 3, "state")]
        assert rows("torn") == [(1, None, 1, "state"), (3, None, 3, "late"), (4, None, 4, "late")]
        arrive(spark, folder, "done", 2, 3)  # a repeat, and one that comes when all is over
        arrive(spark, folder, "torn", 1, 2)
        query.processAllAvailable()
        assert rows("done") == [(1, 119, 1, "state"), (2, 118, 3, "state"), (3, None, 3, "late")]
        assert rows("torn")[1] == (2, None, 2, "late")
    finally:
        query.stop()
    kept = spark.read.format("statestore").option("path", str(tmp_path / "over")).option("stateVarName", "totals").load()
    assert not {"done", "torn"} & {r.key.match_id for r in kept.select("key").collect()}


def test_ingest_takes_new_and_revised_files_once(spark, tmp_path):
    people = {"A": "a", "B": "b", "X": "x"}
    doc = lambda n: match(innings("India", [ball("A", "X", "B", 1)] * n), people=people)
    folder, root, check = tmp_path / "in", str(tmp_path / "matches"), str(tmp_path / "ckpt")

    def run():
        stream = ingest.document_stream(spark, str(folder), "odi")
        balls = F.aggregate("innings", F.lit(0), lambda a, i: a + F.size(i["overs"][0]["deliveries"]))
        ingest.ingest(stream, root, check, lambda d: d.select(
            "match_id", "modified_at", balls.alias("balls"))).awaitTermination(120)
        return {r.match_id: r.balls for r in publish.read_snapshot(spark, root).collect()}

    save(folder, m1=doc(1), m2=doc(2))
    assert run() == {"m1": 1, "m2": 2}
    before = publish.current_path(spark, root)
    assert run() == {"m1": 1, "m2": 2} and publish.current_path(spark, root) == before
    time.sleep(1.1)
    save(folder, m3=doc(3))
    (folder / "m2.r2.json").write_text(json.dumps(doc(5)))
    assert run() == {"m1": 1, "m2": 5, "m3": 3}


def test_one_revised_match_rewrites_one_bucket(spark, tmp_path):
    people = {"A": "a", "B": "b", "X": "x"}
    doc = lambda n: match(innings("India", [ball("A", "X", "B", 1)] * n), people=people)
    folder, root, check = tmp_path / "in", str(tmp_path / "balls"), str(tmp_path / "ckpt")

    def run():
        stream = ingest.document_stream(spark, str(folder), "odi")
        ingest.ingest(stream, root, check, lambda d: documents.flatten(d).select("match_id", "innings", "seq"), ["match_id", "innings", "seq"], buckets=8).awaitTermination(120)
        return publish.current(spark, root)["folders"]

    save(folder, **{f"m{k}": doc(2) for k in range(20)})
    before = run()
    time.sleep(1.1)
    (folder / "m7.r2.json").write_text(json.dumps(doc(3)))
    after = run()
    assert len(before) > 4 and sum(before.get(b) != after[b] for b in after) == 1
    assert publish.read_snapshot(spark, root).groupBy("match_id").count().where("match_id = 'm7'").first()["count"] == 3


def test_streamed_documents_give_the_deliveries_of_a_batch(spark, tmp_path):
    people = {"A": "a", "B": "b", "X": "x"}
    doc = lambda n: match(innings("India", [ball("A", "X", "B", 1)] * n), people=people)
    folder, root, check = tmp_path / "in", str(tmp_path / "balls"), str(tmp_path / "ckpt")
    cols = ("match_id", "format_key", "innings", "seq", "batter_id", "runs_total")

    def run():
        stream = ingest.document_stream(spark, str(folder), "odi")
        ingest.ingest(stream, root, check, lambda d: documents.flatten(d).select(*cols), ["match_id", "innings", "seq"]).awaitTermination(120)
        got = sorted(tuple(r) for r in publish.read_snapshot(spark, root).select(*cols).collect())
        batch = documents.flatten(documents.read_documents(spark, str(folder), "odi")).select(*cols)
        assert got == sorted(tuple(r) for r in batch.collect())
        return len(got)

    save(folder, m1=doc(3), m2=doc(4))
    assert run() == 7
    time.sleep(1.1)
    (folder / "m2.r2.json").write_text(json.dumps(doc(2)))
    assert run() == 5
