"""Balls written once by match, and what is made of them without dealing them out again."""

from __future__ import annotations

import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from overstats import catalog
from overstats.catalog.players import batted
from overstats.operators import players, state
from overstats.plans import read
from overstats.sources.tables import Tables
from tests.compare import canonical, difference

catalog.load()
LINES = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Forty matches of 240 balls, whose batters and bowlers come often enough for every gate; some balls come twice."""
    rows = [(64 * match + 32 * (k % 2) + k % 5, k // 2 + 1, (k * 7 + match) % 12 + 60 * (k % 3), (3 * k + match) % 5, float(1 + (5 * k + 3 * match) % 50), 100.0 + k % 9,
             0.01 * ((7 * k + match) % 11), 0.01 * ((3 * k + match) % 9)) for match in range(40) for k in range(240)]
    path = str(tmp_path_factory.mktemp("held"))
    spark.createDataFrame(rows + rows[::37], LINES).repartition(3).write.parquet(f"{path}/lineitem.parquet")
    return path


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_innings_of_held_balls_need_no_shuffle(spark, folder):
    rows = Tables(spark, folder).hold(mixed=True)
    for made in (state.batting_innings(rows), state.bowling_innings(rows), players.squads_from_deliveries(rows)):
        assert "Exchange" not in plan(made)


def test_balls_are_held_once_for_all(spark, folder):
    t = Tables(spark, folder)
    t.hold(arrivals=True)
    held = t._held
    t.hold(), t.hold(mixed=True), t.hold(mixed=True, arrivals=True)
    assert t._held is held
    assert batted(t) is batted(t)
    names = {x.name for x in spark.catalog.listTables()}
    assert not [x for x in names if x.startswith("overstats_")]


def test_held_balls_are_the_balls(spark, folder):
    t = Tables(spark, folder)
    want = t.bound(True).drop("wickets")
    for arrivals in (False, True):
        got = t.hold(mixed=True, arrivals=arrivals).select(*want.columns)
        assert difference(got.toArrow(), want.toArrow()) is None


@pytest.mark.parametrize("name", ["careers", "player_profiles", "compared_profiles", "compared_measures", "player_index", "replay_context", "batting_splits", "bowling_splits"])
def test_query_of_held_balls_equals_its_sql(spark, folder, name):
    got = catalog.QUERIES[name](spark, folder).toArrow()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    assert difference(got, con.execute(catalog.ORACLE[name]).to_arrow_table()) is None


def test_arrivals_are_those_of_appearances(spark):
    wicket = lambda who: [("run out", who, who)]
    rows = [(1, 1, s, a, a, b, b, w, f) for s, (a, b, w, f) in enumerate([
        ("x", "y", [], True), ("y", "x", wicket("q"), True), ("x", "z", wicket("x") + wicket("r"), False), (None, "z", [], True),
        ("", "v", [], True), ("z", None, [], True), ("v", "z", None, True), ("x", "v", [], True), ("s", "s", wicket(None), True), ("z", "s", [], True)])]
    rows += [(2, i, s, f"p{(s * i) % 4}", "", f"p{s % 3}", "", [], s % 3 > 0) for i in (1, 2) for s in range(9)]
    balls = spark.createDataFrame(rows, "match_id long, innings int, seq int, batter_id string, batter string, non_striker_id string, non_striker string, "
                                  "wickets array<struct<kind:string,player_out_id:string,player_out:string>>, is_faced boolean")
    plain = balls.withColumn("wickets", F.coalesce("wickets", F.array().cast(balls.schema["wickets"].dataType)))
    want = state.faced_before(state.appearances(plain).where("rank = 0")).select("match_id", "innings", "seq", "position", "faced_before")
    got = state.arrivals(balls)
    assert got.count() == balls.count()
    known = got.where("batter_id <> ''").select(*want.columns)
    assert canonical(known.toArrow()) == canonical(want.toArrow())
    assert got.where("batter_id IS NULL OR batter_id = ''").where("position IS NOT NULL").count() == 0
    assert canonical(players.batting_positions(balls).select(*want.columns).toArrow()) == canonical(want.toArrow())


def test_people_are_joined_to_meetings_not_to_balls(spark, folder):
    t = Tables(spark, folder)
    for splits in (players.batting_splits(t.hold(arrivals=True), t.people), players.bowling_splits(t.hold(), t.people)):
        lines = splits._jdf.queryExecution().optimizedPlan().toString().splitlines()
        depth = lambda x: len(x) - len(x.lstrip(" :+-"))
        for i, line in enumerate(lines):
            if "Join" in line and "strategy=broadcast" not in line:  # what is joined has been folded; people of several rows are sent
                below = itertools.takewhile(lambda x: depth(x) > depth(line), lines[i + 1:])
                assert any("Aggregate" in x and "count(" in x for x in below)


def test_a_ball_counts_once_for_each_row_of_its_players(spark, folder):
    t = Tables(spark, folder)
    balls, who = t.hold(arrivals=True), t.people
    who = who.unionByName(who.where("person_id IN ('p01', 'p07')")).unionByName(who.where("person_id = 'p01'"))
    each = players.with_people(balls, who).where("batter_id <> ''").groupBy(F.col("batter_id").alias("person_id"), F.col("year").alias("subject")).agg(
        players.batting_counts()["balls"].alias("balls"))
    got = players.batting_splits(balls, who).where("dimension = 'year'").select("person_id", "subject", "balls")
    assert canonical(got.toArrow()) == canonical(each.toArrow())
    each = players.with_people(balls, who).where("bowler_id <> ''").groupBy(F.col("bowler_id").alias("person_id"), "batting_hand").agg(
        players.bowling_counts()["runs"].alias("runs"))
    got = players.bowling_splits(balls, who).where("dimension = 'hand'").select("person_id", F.col("subject").alias("batting_hand"), "runs")
    assert canonical(got.toArrow()) == canonical(each.toArrow())


def test_context_of_people_of_two_sides(spark):
    people = [(1, "a", "f", "A"), (1, "a", "f", "B"), (1, "b", "f", "A"), (1, "c", "f", None), (2, "a", "f", "A"), (2, "b", "g", "C"), (None, "a", "f", "A"), (1, None, "f", "A")]
    faced = [(1, "x", "rf", "B"), (1, "y", "", "B"), (1, "y", "ob", "B"), (1, "z", "rf", "A"), (1, "w", None, None), (2, "x", "rf", "A"), (2, "x", "rf", "D"), (2, None, "ob", "D"), (None, "x", "rf", "B")]
    subjects = [("type", "rf"), ("type", "ob"), ("type_phase", "rf|death"), ("type_phase", "ob|middle"), ("type_phase", "ob|death"), ("vs_bowler", "x"), ("vs_bowler", "y"),
                ("vs_bowler", "z"), ("vs_bowler", "w"), ("phase", "rf")]
    splits = [(p, f, d, s, 60 + i, i, 1) for p in ("a", "b", "c") for f in ("f", "g") for i, (d, s) in enumerate(subjects)]
    want = set()
    for (m, p, f, team), (n, bowler, kind, other) in itertools.product(people, faced):
        if m is not None and m == n and team and other and team != other:
            for q, g, d, s, *figures in splits:
                if (p, f) == (q, g) and ((d == "vs_bowler" and s == bowler) or (d in ("type", "type_phase") and kind and s.split("|")[0] == kind)):
                    want.add((m, p, f, d, s, *figures))
    got = read.replay_context(
        spark.createDataFrame(people, "match_id long, person_id string, format_key string, team string"),
        spark.createDataFrame([], "person_id string, format_key string, kind string, rank int, dimension_key string, subject string"),
        spark.createDataFrame(splits, "person_id string, format_key string, dimension string, subject string, balls long, runs long, outs long"),
        spark.createDataFrame(faced, "match_id long, bowler_id string, bowling_type string, team string"))["splits"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 20
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2  # one of a match's sides, one with the splits
