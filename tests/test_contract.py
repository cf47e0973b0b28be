"""Contracts of tables made by hand."""

from __future__ import annotations

from overstats.operators import contract


def test_every_rule_of_a_table_is_counted_and_nulls_are_faults(spark):
    rows = [("g1", "odi-m", 2, 10, 12, 1, 2, 20, 5.0, 12.0), ("g1", "odi-m", 0, -1, None, 0, 3, 0, None, None), (None, "x", 1, 6, 6, 0, 0, 0, 6.0, None)]
    table = spark.createDataFrame(rows, "venue_key string, format_key string, matches long, runs long, balls long, wickets long, first_innings long, first_innings_runs long, "
                                        "runs_per_over double, balls_per_wicket double")
    found = {(r.key, r.rule) for r in contract.violations(table, "venues").collect()}
    assert found == {("g1|odi-m", "runs"), ("g1|odi-m", "balls"), ("g1|odi-m", "matches"), ("g1|odi-m", "first_innings_of_matches"),
                     ("g1|odi-m", "key"), ("∅|x", "format_key")}
    counts = {r.rule: (r.checked, r.broken) for r in contract.summary(table, "venues").collect()}
    assert counts["matches"] == (3, 1) and counts["wickets"] == (3, 0) and set(counts) == set(contract.RULES["venues"])
    assert contract.violations(table.limit(0), "venues").count() == 0


def test_references_between_tables(spark):
    ids = lambda *x: spark.createDataFrame([(i, "odi-m", "batting", "avg", 50.0, 10) for i in x], "person_id string, format_key string, discipline string, axis string, percentile double, balls long")
    careers = spark.createDataFrame([("a", "odi-m", 1, None, 3, None, None, None, None, None, 0, 6, 12, None, 4.0, 12.0)], "person_id string, format_key string, matches long, runs long, wickets long, highest long, "
                                    "hundreds long, fifties long, bat_avg double, bat_sr double, five_wickets long, runs_conceded long, bowl_balls long, outs long, bowl_avg double, bowl_econ double").withColumn("balls", contract.F.lit(None).cast("long"))
    found = {tuple(r) for r in contract.check({"profiles": ids("a", "b", None), "careers": careers}).collect()}
    assert found == {("profiles", "b", "person_id in careers"), ("careers", "a|odi-m", "bowl_avg"), ("careers", "a|odi-m", "bowl_econ")}
