"""Exact ranks and quantiles against brute force, one group holding most rows."""

from __future__ import annotations

import bisect
import random

import numpy as np
from pyspark.sql import functions as F

from overstats.operators import ranking


def sample(spark):
    rng = random.Random(7)
    rows = [("hot", float(rng.randint(0, 400)), rng.random() < 0.7) for _ in range(6000)]
    rows += [(f"g{i % 9}", float(rng.randint(0, 20)), True) for i in range(900)]
    return rows, spark.createDataFrame(rows, "g string, v double, pool boolean")


def test_ranks_match_bisection_with_ties_and_outsiders(spark):
    rows, df = sample(spark)
    pools = {}
    for g, v, p in rows:
        pools.setdefault(g, [])
        if p:
            pools[g].append(v)
    pools = {g: sorted(vs) for g, vs in pools.items()}
    got = ranking.ranks_against_pool(df, ("g",), "v", "pool").withColumn(
        "pct", ranking.mid_rank(F.col("below"), F.col("ties"), F.col("n"), F.lit(True)))
    seen = 0
    for r in got.collect():
        vs = pools[r.g]
        left, right = bisect.bisect_left(vs, r.v), bisect.bisect_right(vs, r.v)
        assert (r.below, r.below + r.ties, r.n) == (left, right, len(vs))
        assert r.pct == 100.0 * ((left + right) / 2.0) / len(vs)
        seen += 1
    assert seen == len(rows)


def test_no_task_holds_more_than_its_share_of_a_hot_group(spark):
    rows = [("hot", float(k)) for k in range(20_000)] + [(f"g{k % 50}", float(k)) for k in range(400)] + [(None, 1.0), ("hot", None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = ranking.pool_ranks(spark.createDataFrame(rows, "g string, v double").repartition(8), ("g",), "v")
        tasks = [r["count"] for r in ranked.groupBy(F.spark_partition_id()).count().collect()]
        assert max(tasks) <= 2 * 20_401 / ranking.RANGES
        assert {(r.v, r.below, r.n) for r in ranked.where("g = 'hot'").collect()} == {(float(k), k, 20_000) for k in range(20_000)}
        assert ranked.where("g is null").select("below", "ties", "n").collect() == [(0, 1, 1)]
        plan = ranked._jdf.queryExecution().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quantiles_interpolate(spark):
    rows, df = sample(spark)
    points = (0.1, 0.25, 0.5, 0.75, 0.9)
    for r in ranking.quantiles(df, ("g",), "v", points).collect():
        vs = np.array([v for g, v, _p in rows if g == r.g])
        assert r.n == len(vs)
        for q in points:
            assert abs(r[f"p{round(q * 100)}"] - np.quantile(vs, q)) < 1e-9


def test_cursors_walk_the_whole_order(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"])) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, x int, y string")
    for order in ([("x", False), ("y", True), ("id", True)], [("y", False), ("x", True), ("id", False)]):
        want = [r.id for r in df.orderBy(*ranking.ordered(order)).collect()]
        got, cursor = [], None
        while page := ranking.after(df, order, cursor, 7).collect():
            got += [r.id for r in page]
            cursor = ranking.cursor_of(page[-1], order)
        assert got == want
    plan = ranking.after(df, order, cursor, 7)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=7" in plan and "Exchange" not in plan


def test_lookups_reach_the_scan_and_prune(spark, tmp_path):
    from overstats.plans import read

    path = str(tmp_path / "lookup")
    read.write_lookup(spark.range(200_000).select(F.concat(F.lit("m"), F.hex(F.col("id") * 7919)).alias("slug"), "id"), path, "slug")
    found = read.look_up(spark, path, "slug", ["m1EEF", "m3DDE", "nowhere"])
    assert {r.id for r in found.collect()} == {1, 2}
    plan = found._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [In(slug" in plan.toString()
    scan = plan.collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() < 100_000  # row groups without the values aren't read


def test_pages_past_the_end():
    assert ranking.page_numbers(101, 3, 50) == {"pages": 3, "past_end": False, "previous": 2, "next": None}
    assert ranking.page_numbers(10, 9, 50) == {"pages": 1, "past_end": True, "previous": 1, "next": None}
