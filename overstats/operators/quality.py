"""Contract checks and reconciliation between outputs, as violation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row per broken rule: (rule, key). A null outcome is a violation."""
    broken = F.array_compact(F.array(*[
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()
    ]))
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("∅")) for k in keys])
    return df.select(key.alias("key"), F.explode(broken).alias("rule"))


def duplicates(df: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """Keys that occur more than once."""
    key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("∅")) for k in keys])
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("_n")).where(
        "_n > 1").select("key", F.lit(rule).alias("rule"))


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str, rule: str
            ) -> DataFrame:
    """Values of a reference that no parent row has."""
    refs = child.where(F.col(column).isNotNull()).select(F.col(column).alias("key")).distinct()
    return refs.join(
        parent.select(F.col(parent_column).alias("key")), "key", "left_anti"
    ).select(F.col("key").cast("string").alias("key"), F.lit(rule).alias("rule"))


def schema_problems(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """Missing, mistyped and unknown columns."""
    have = dict(df.dtypes)
    out = [f"{c}: missing" for c in expected if c not in have]
    out += [f"{c}: {have[c]}, not {t}" for c, t in expected.items() if c in have and have[c] != t]
    return out + [f"{c}: unknown" for c in have if c not in expected]


# fixed values: allowed formats, genders, results
def match_rules() -> dict[str, Column]:
    c = F.col
    iso = r"^\d{4}-\d{2}-\d{2}$"
    return {
        "format_key": c("format_key").rlike(r"^(test|odi|t20i)-(m|w)$"),
        "gender": c("gender").isin("male", "female"),
        "start_date": c("start_date").rlike(iso),
        "end_date": c("end_date").rlike(iso) & (c("end_date") >= c("start_date")),
        "teams": c("team1").isNotNull() & c("team2").isNotNull() & (c("team1") != c("team2")),
        "result_type": c("result_type").isin("win", "tie", "draw", "noResult"),
        "winner": (c("result_type") == "win") == c("winner").isNotNull(),
        "winner_played": c("winner").isNull() | c("winner").isin(c("team1"), c("team2")),
        "result_text": F.length("result_text") > 0,
        "innings": F.forall("innings", lambda i: (i["runs"] >= 0) & (i["balls"] >= 0)
                            & (i["wickets"] >= 0)),
    }


def split_rules(discipline: str) -> dict[str, Column]:
    c = F.col
    common = {
        "balls": c("balls") >= 0, "runs": c("runs") >= 0,
        "dots": (c("dots") >= 0) & (c("dots") <= c("balls")),
        "subject": F.length("subject") > 0,
        "boundary_runs": c("fours") * 4 + c("sixes") * 6 <= c("runs"),
    }
    if discipline == "batting":
        common["scoring"] = c("dots") + c("scoring_balls") == c("balls")
        common["outs"] = c("outs") >= 0
    else:
        common["wickets"] = c("wickets") >= 0
    return common


def split_sums(splits: DataFrame, dimension: str, counters: Sequence[str]) -> DataFrame:
    """Where a dimension that covers every ball doesn't add up to the whole."""
    keys = ["person_id", "format_key"]
    whole = splits.where(F.col("dimension") == "all")
    parts = splits.where(F.col("dimension") == dimension).groupBy(*keys).agg(
        *[F.sum(k).alias(f"_{k}") for k in counters])
    differs = F.lit(False)
    for k in counters:
        differs = differs | ~F.col(k).eqNullSafe(F.col(f"_{k}"))
    return whole.join(parts, keys, "left").where(differs).select(
        F.concat_ws("|", *keys).alias("key"), F.lit(f"{dimension} sums").alias("rule"))


def reconcile_innings(replay_totals: DataFrame, match_totals: DataFrame) -> DataFrame:
    """Innings whose totals differ between replays and match rows, either way."""
    c = F.col
    keys = ["match_id", "innings"]
    figures = ("team", "runs", "wickets", "balls", "penalty_runs")
    pick = lambda df, p: df.select(*keys, F.struct(*figures).alias(p))
    both = pick(replay_totals, "got").join(pick(match_totals, "want"), keys, "full_outer")
    return both.where(~c("got").eqNullSafe(c("want"))).select(
        *keys,
        F.when(c("got").isNull(), "no replay").when(c("want").isNull(), "no match row")
        .otherwise("totals differ").alias("problem"), "got", "want",
    )


BOWLING_FIGURES = ("match_id", "person_id", "balls", "runs", "wickets", "maidens")


def reconcile_bowling(replay_bowling: DataFrame, logged: DataFrame,
                      exported: DataFrame | None = None) -> DataFrame:
    """Bowling innings in only one of the two sources, compared as multisets.

    ``exported`` (person_id, format_key) limits the check to published bowlers.
    """
    got, want = replay_bowling, logged
    if exported is not None:
        keys = ["person_id", "format_key"]
        got = got.join(exported.select(*keys), keys, "left_semi")
        want = want.join(exported.select(*keys), keys, "left_semi")
    got, want = got.select(*BOWLING_FIGURES), want.select(*BOWLING_FIGURES)
    return got.exceptAll(want).withColumn("only_in", F.lit("replay")).unionByName(
        want.exceptAll(got).withColumn("only_in", F.lit("player")))


def reconcile_team_bowlers(replay_bowling: DataFrame, top_bowlers: DataFrame) -> DataFrame:
    """Leading bowlers whose totals the replays don't add up to."""
    c = F.col
    keys = ["team_id", "format_key", "person_id"]
    sums = replay_bowling.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_innings"), F.sum("balls").alias("_balls"),
        F.sum("runs").alias("_runs"), F.sum("wickets").alias("_wickets"),
        F.count(F.when(c("wickets") >= 5, 1)).alias("_five"),
    )
    same = (
        c("innings").eqNullSafe(c("_innings")) & c("balls").eqNullSafe(c("_balls"))
        & c("runs_conceded").eqNullSafe(c("_runs")) & c("wickets").eqNullSafe(c("_wickets"))
        & c("five_wickets").eqNullSafe(c("_five"))
    )
    return top_bowlers.join(sums, keys, "left").where(~same).select(*keys)


def extras_mismatches(deliveries: DataFrame) -> DataFrame:
    """Balls whose extras by kind don't add up to their extras."""
    c = F.col
    kinds = c("wides") + c("noballs") + c("byes") + c("legbyes") + c("penalty")
    return deliveries.where(kinds != c("runs_extras")).groupBy("match_id", "innings").agg(
        F.count(F.lit(1)).alias("balls"), F.min("seq").alias("first_seq"))


def explicit_zero_extras(documents: DataFrame) -> DataFrame:
    """Matches that write a wide or no-ball of 0, which two readings disagree on."""
    zero = lambda d, k: F.coalesce(F.try_element_at(d["extras"], F.lit(k)) == 0, F.lit(False))
    found = F.exists("innings", lambda i: F.exists(i["overs"], lambda o: F.exists(
        o["deliveries"], lambda d: zero(d, "wides") | zero(d, "noballs"))))
    return documents.where(F.coalesce(found, F.lit(False))).select("match_id")


def check_counts(replay_totals: DataFrame, replay_bowling: DataFrame, top_bowlers: DataFrame
                 ) -> DataFrame:
    """How much a reconciliation looked at."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(name).alias("checked"), "n")
    return (
        count(replay_totals.select("match_id").distinct(), "replays")
        .unionByName(count(replay_totals, "innings"))
        .unionByName(count(replay_bowling, "bowler_innings"))
        .unionByName(count(top_bowlers, "team_bowlers"))
    )
