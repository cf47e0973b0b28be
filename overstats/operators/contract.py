"""The contract of every published table: rules as data, checked in one pass a table, and references as anti joins.

A rule is a SQL condition that holds for every row; null counts as broken. ``RULES`` names them by table, ``REFERENCES`` the
columns that must occur elsewhere, ``KEYS`` what tells rows apart.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overstats.operators import quality

FORMAT_KEY = r"format_key RLIKE '^(test|odi|t20i|ipl|bbl|psl)(-(m|w))?$'"


def counts(*names: str) -> dict[str, str]:
    """Counters are there and not negative."""
    return {n: f"{n} >= 0" for n in names}


def rate(name: str, top: str, bottom: str, scale: int = 1) -> dict[str, str]:
    """A rate is that of its counters, and null exactly if there is nothing to divide by."""
    return {name: f"CASE WHEN {bottom} > 0 THEN abs({name} - {scale} * {top} / CAST({bottom} AS DOUBLE)) <= 1e-9 * (1 + abs({name})) ELSE {name} IS NULL END"}


RECORD = {
    **counts("matches", "won", "lost", "tied", "drawn", "no_result"), "matches": "matches >= 1",
    "results": "won + lost + tied + drawn + no_result = matches",
    **rate("win_pct", "won", "(won + lost + tied + drawn)", 100),
}
SPLIT = {"format_key": FORMAT_KEY, "subject": "length(subject) > 0", "dots_of_balls": "dots <= balls", "boundary_runs": "fours * 4 + sixes * 6 <= runs"}

RULES: dict[str, dict[str, str]] = {
    "batting_splits": SPLIT | counts("balls", "runs", "outs", "fours", "sixes", "dots", "singles") | {
        "dimension": "dimension IN ('all', 'type', 'family', 'phase', 'opposition', 'country', 'venue', 'home', 'innings_no', 'chase', 'year', 'position', 'entry', 'type_phase', 'vs_bowler')",
        "scoring": "dots + scoring_balls = balls", "whole": "(dimension = 'all') = (subject = 'all')"},
    "bowling_splits": SPLIT | counts("balls", "runs", "wickets", "fours", "sixes", "dots", "wides", "noballs") | {
        "dimension": "dimension IN ('all', 'hand', 'phase', 'opposition', 'country', 'home', 'year', 'innings_no', 'vs_batter')",
        "extras_of_runs": "wides + noballs <= runs", "whole": "(dimension = 'all') = (subject = 'all')"},
    "batting_innings": counts("runs", "balls", "fours", "sixes") | {
        "format_key": FORMAT_KEY, "date": r"date RLIKE '^\\d{4}-\\d{2}-\\d{2}$'", "position": "position BETWEEN 1 AND 11 OR position > 11", "innings": "innings >= 1",
        "boundary_runs": "fours * 4 + sixes * 6 <= runs", "dismissal": "NOT out OR length(dismissal) > 0", "teams": "team <> opposition"},
    "bowling_innings": counts("balls", "runs", "wickets", "maidens") | {
        "format_key": FORMAT_KEY, "date": r"date RLIKE '^\\d{4}-\\d{2}-\\d{2}$'", "maiden_balls": "maidens * 6 <= balls", "innings": "innings >= 1"},
    "careers": {
        "format_key": FORMAT_KEY, "matches": "matches >= 1 OR matches IS NULL", "something": "runs IS NOT NULL OR wickets IS NOT NULL",
        "highest": "runs IS NULL OR highest <= runs", "milestones": "runs IS NULL OR hundreds * 100 + fifties * 50 <= runs", "five_wickets": "wickets IS NULL OR five_wickets * 5 <= wickets"}
    | {k: f"runs IS NULL OR ({v})" for k, v in (rate("bat_avg", "runs", "outs") | rate("bat_sr", "runs", "balls", 100)).items()}
    | {k: f"wickets IS NULL OR ({v})" for k, v in (rate("bowl_avg", "runs_conceded", "wickets") | rate("bowl_econ", "runs_conceded", "bowl_balls", 6)).items()},
    "team_records": RECORD | {
        "format_key": FORMAT_KEY, "facet": "facet IN ('overall', 'year', 'opponent', 'venue_type', 'order', 'toss', 'decision', 'venue')",
        "span": "first_date <= last_date"},
    "venues": counts("runs", "balls", "wickets", "first_innings", "first_innings_runs") | rate("runs_per_over", "runs", "balls", 6) | rate("balls_per_wicket", "balls", "wickets") | {
        "matches": "matches >= 1", "format_key": FORMAT_KEY, "first_innings_of_matches": "first_innings <= matches"},
    "claims": {
        "format_key": FORMAT_KEY, "kind": "kind IN ('strength', 'weakness')", "rank": "rank >= 1", "percentile": "percentile BETWEEN 0 AND 100", "balls": "balls >= 0",
        "side": "(kind = 'strength') = (percentile >= 50)", "confidence": "confidence IN ('high', 'medium', 'low')"},
    "profiles": {"format_key": FORMAT_KEY, "axis": "length(axis) > 0", "percentile": "percentile BETWEEN 0 AND 100", "balls": "balls >= 0"},
    "cohorts": {"format_key": FORMAT_KEY, "n": "n >= 1", "order": "p10 <= p25 AND p25 <= p50 AND p50 <= p75 AND p75 <= p90"},
}

KEYS: dict[str, list[str]] = {
    "batting_splits": ["person_id", "format_key", "dimension", "subject"], "bowling_splits": ["person_id", "format_key", "dimension", "subject"],
    "batting_innings": ["match_id", "innings", "person_id"], "bowling_innings": ["match_id", "innings", "person_id"],
    "careers": ["person_id", "format_key"], "team_records": ["team_id", "format_key", "facet", "subject"], "venues": ["venue_key", "format_key"],
    "claims": ["person_id", "format_key", "kind", "rank"], "profiles": ["person_id", "format_key", "discipline", "axis"], "cohorts": ["format_key", "discipline", "metric"],
}

#: (table, column, table that must have its values, column there)
REFERENCES = [
    ("batting_splits", "person_id", "careers", "person_id"), ("bowling_splits", "person_id", "careers", "person_id"),
    ("claims", "person_id", "careers", "person_id"), ("profiles", "person_id", "careers", "person_id"),
    ("batting_innings", "match_id", "matches", "match_id"), ("bowling_innings", "match_id", "matches", "match_id"),
]


def violations(table: DataFrame, name: str) -> DataFrame:
    """(key, rule) of everything in a table that breaks its contract: rows in one pass, repeated keys in one aggregate."""
    rows = quality.violations(table, {rule: F.expr(test) for rule, test in RULES[name].items()}, KEYS[name])
    return rows.unionByName(quality.duplicates(table, KEYS[name], "key"))


def summary(table: DataFrame, name: str) -> DataFrame:
    """(rule, checked, broken) of every rule of a table, broken or not, from one aggregate."""
    rules = RULES[name]
    sums = table.agg(F.count(F.lit(1)).alias("checked"), *[
        F.count(F.when(~F.coalesce(F.expr(test), F.lit(False)), 1)).alias(f"_{k}") for k, test in enumerate(rules.values())])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.col("checked"), F.col(f"_{k}").alias("broken")) for k, rule in enumerate(rules)])))


def check(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, key, rule) over all tables of a build that have a contract, references among them included."""
    parts = [violations(df, name).select(F.lit(name).alias("table"), "key", "rule") for name, df in tables.items() if name in RULES]
    for child, column, parent, there in REFERENCES:
        if child in tables and parent in tables:
            lost = quality.orphans(tables[child], column, tables[parent], there, f"{column} in {parent}")
            parts.append(lost.select(F.lit(child).alias("table"), "key", "rule"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
