"""The whole build over documents folded from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from overstats.catalog.matches import _places
from overstats.plans import build, read
from overstats.sources.tables import Tables


def test_build_publishes_reconciles_and_rebuilds_without_changes(spark, tmp_path):
    tables = Tables(spark, "/root/testdata/sf0.001")
    bare = tables.documents(mixed=True).drop("venue_key", "country")
    names = F.map_values(F.col("info.registry.people"))
    keys = F.map_keys(F.col("info.registry.people"))
    docs = bare.withColumn("info", F.col("info").withField(
        "players", F.map_from_arrays(F.array(F.get("info.teams", F.lit(0))), F.array(keys))))
    docs = docs.withColumn("info", F.col("info").withField("outcome", F.struct(
        F.lit(None).cast("string").alias("winner"), F.lit("no result").alias("result"),
        F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("eliminator"),
        F.lit(None).cast("string").alias("bowl_out"),
        F.lit(None).cast("struct<runs:int,wickets:int,innings:int>").alias("by"))))
    for field, kind in (("toss", "struct<winner:string,decision:string>"), ("overs", "int"),
                        ("event", "struct<name:string,stage:string,match_number:int,group:string>"),
                        ("match_type_number", "int"), ("player_of_match", "array<string>"),
                        ("missing", "array<string>")):
        docs = docs.withColumn("info", F.col("info").withField(field, F.lit(None).cast(kind)))
    assert names is not None
    plan = build.plan(docs, _places(tables), tables.people)
    plan.tables = {k: v for k, v in plan.tables.items()
                   if k in ("matches", "batting_innings", "bowling_splits", "team_records", "replays",
                            "summary", "names")}
    root = str(tmp_path / "build")
    first = build.write(spark, plan, root)
    assert all({r.status for r in df.collect()} == {"inserted"} for df in first.values())
    again = build.write(spark, plan, root)
    assert all({r.status for r in df.collect()} == {"unchanged"} for df in again.values())
    # Countries worked out from the gazetteer agree with the bound ones.
    want = {r.match_id: (r.venue_key, r.country or None) for r in tables.headers(True).collect()}
    got = {r.match_id: (r.venue_key, r.country) for r in plan["matches"].collect()}
    assert got == want
    checks = build.verify(build.Build({
        "matches": plan["matches"], "bowling_innings": build.state.bowling_innings(plan.deliveries)},
        plan.deliveries), plan["replays"])
    assert {k: df.count() for k, df in checks.items()} == {
        "innings": 0, "bowling": 0, "extras": 0, "missing": 0}


def test_parameters_are_validated():
    assert read.parse_params(format="ODI", gender="women", sort="x", page="3", role="bowler", year="12") == {
        "format": "odi", "gender": "female", "page": 3, "role": "bowler"}
    assert read.format_keys("female", None) == ["test-w", "odi-w", "t20i-w"]
    assert read.format_keys() is None


def test_pairs_that_cannot_be_planned_for(spark):
    team = "struct<label:string,gender:string,formats:array<string>>"
    a, b, c = ("A", "male", ["odi"]), ("B", "male", ["t20i"]), ("C", "female", ["odi"])
    pairs = spark.createDataFrame([(1, a, b), (2, a, a), (3, a, c), (4, a, None), (5, a, ("D", "male", ["odi"]))], f"n int, x {team}, y {team}")
    got = [r.why for r in pairs.select("n", read.pair_obstacle("x", "y", "odi").alias("why")).orderBy("n").collect()]
    assert got == ["no odi matches of B", "one team twice", "teams of different genders", "unknown team", None]
