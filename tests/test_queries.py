"""Registered queries against their SQL.

The smallest tables and a spread of queries by default; OVERSTATS_ALL=1 runs
every query (see tests/compare.py for other folders).
"""

from __future__ import annotations

import os

import duckdb
import pytest

from overstats import catalog
from overstats.catalog.base import query
from tests.compare import connect, difference

FOLDER = os.environ.get("OVERSTATS_FOLDER", "/root/testdata/sf0.001")
SPREAD = ("flatten_documents", "scoreboard", "batting_card", "partnerships", "batting_splits",
          "yearly", "match_results", "team_records", "match_countries", "resource_curves",
          "chart_series", "resolved_metadata", "change_set", "contract_violations", "fixture_plans")

catalog.load()


def test_every_query_is_registered_with_its_sql():
    without = set(catalog.QUERIES) - set(catalog.ORACLE)
    assert without == {"win_models"}
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", list(catalog.ORACLE) if os.environ.get("OVERSTATS_ALL") else SPREAD)
def test_query_equals_its_sql(spark, name):
    got = catalog.QUERIES[name](spark, FOLDER).toArrow()
    want = connect(FOLDER).execute(catalog.ORACLE[name]).to_arrow_table()
    assert difference(got, want) is None


def test_recent_matches_are_those_of_every_team(spark, tmp_path):
    rows = [(64 * match + 32 * (k % 2), k // 2 + 1, 7 * k + match, 3 * k + match, float(1 + (5 * k + match) % 50), 100.0 + k, 0.01 * (k % 11), 0.01 * (k % 9))
            for match in range(120) for k in range(14)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double").coalesce(
        1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["team_recent_matches"](spark, str(tmp_path)).toArrow()
    assert got.column_names == ["team_id", "format_key", "match_id", "end_date", "outcome", "rank"]
    assert len(set(got.column("team_id").to_pylist())) == 16 and max(got.column("rank").to_pylist()) == 10
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert difference(got, con.execute(catalog.ORACLE["team_recent_matches"]).to_arrow_table()) is None


def test_a_name_is_given_once():
    def team_recent_matches(t):
        """A query of a name that is taken."""

    before = dict(catalog.QUERIES), dict(catalog.ORACLE)
    with pytest.raises(ValueError, match="two queries are named team_recent_matches"):
        query("SELECT 1")(team_recent_matches)
    assert (catalog.QUERIES, catalog.ORACLE) == before
