"""Team records, phases and leading players."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overstats import config as C
from overstats.functions import flags, geography, rates, text
from overstats.operators.ranking import top_per_group

OUTCOMES = ("won", "lost", "tied", "drawn", "no_result")
TEAM = ("team_id", "format_key")


def sides(matches: DataFrame) -> DataFrame:
    """Two rows per match, one from each team's point of view."""
    c = F.col
    pair = F.array(
        F.struct(c("team1").alias("team"), c("team2").alias("opponent")),
        F.struct(c("team2").alias("team"), c("team1").alias("opponent")),
    )
    rows = matches.withColumn("_side", F.explode(pair)).select(
        "*", c("_side.team").alias("team"), c("_side.opponent").alias("opponent")
    ).where(c("team").isNotNull()).drop("_side")
    return rows.withColumns(
        {
            "team_id": text.team_id(c("team"), c("gender")),
            "opponent_id": text.team_id(c("opponent"), c("gender")),
            "outcome": F.when(c("winner") == c("team"), "won")
            .when(c("winner").isNotNull(), "lost")
            .when(c("result_type") == "tie", "tied")
            .when(c("result_type") == "draw", "drawn")
            .otherwise("no_result"),
        }
    )


def facets() -> dict[str, Column]:
    """Every way a team's record is cut; a null subject leaves the row out."""
    c = F.col
    won_toss = c("toss_winner") == c("team")
    return {
        "overall": F.lit("all"),
        "year": F.substring("start_date", 1, 4),
        "opponent": c("opponent_id"),
        "venue_type": geography.venue_type(
            c("team"), F.coalesce("opponent", F.lit("")), c("country")),
        "order": F.when(c("batting_first").isNotNull(),
                        F.when(c("batting_first") == c("team"), "batting_first")
                        .otherwise("chasing")),
        "toss": F.when(c("toss_winner").isNotNull(),
                       F.when(won_toss, "won").otherwise("lost")),
        "decision": F.when(won_toss & c("toss_decision").isin("bat", "field"),
                           c("toss_decision")),
        "venue": c("venue_key"),
    }


def records(matches: DataFrame) -> DataFrame:
    """Won, lost, tied, drawn, no result per team, format, facet and subject.

    One fan-out and one aggregation for all facets; counts fold before the
    shuffle, so a team in a third of all matches costs a row per task.
    """
    c = F.col
    pairs = F.array(*[
        F.struct(F.lit(name).alias("facet"), subject.alias("subject"))
        for name, subject in facets().items()
    ])
    batted_first = c("batting_first") == c("team")
    total = F.when(batted_first, c("first_innings_total"))
    rows = sides(matches).select(
        "team", *TEAM, "outcome", "end_date", "start_date", "match_id", "opponent",
        total.alias("first_total"), F.inline(pairs),
    ).where(c("subject").isNotNull())
    out = rows.groupBy(
        *TEAM, "facet", "subject"
    ).agg(
        F.max("team").alias("team"), F.count(F.lit(1)).alias("matches"),
        *[flags.count_if(c("outcome") == o).alias(o) for o in OUTCOMES],
        F.min("start_date").alias("first_date"), F.max("end_date").alias("last_date"),
        F.max(F.struct("end_date", "match_id"))["match_id"].alias("last_match_id"),
        F.count("first_total").alias("first_innings"),
        flags.total(c("first_total")).alias("first_innings_runs"),
    )
    return out.withColumn("win_pct", rates.win_pct())


def top_venues(records_: DataFrame, limit: int = C.TEAM_VENUES) -> DataFrame:
    rows = records_.where(F.col("facet") == "venue")
    ranked = top_per_group(rows, TEAM, (F.desc("matches"), F.asc("subject")), limit)
    return ranked.withColumn(
        "first_innings_avg", rates.ratio(F.col("first_innings_runs"), F.col("first_innings"))
    )


def phases(deliveries: DataFrame) -> DataFrame:
    """Totals by phase from both sides of the ball, extras included."""
    c = F.col
    side = F.array(
        F.struct(F.lit("batting").alias("side"), c("batting_team").alias("team")),
        F.struct(F.lit("bowling").alias("side"), c("bowling_team").alias("team")),
    )
    # Fold each innings' phase first: innings are then counted, not collected.
    folded = deliveries.groupBy(
        "match_id", "innings", "phase", "format_key", "fmt", "gender", "batting_team",
        "bowling_team",
    ).agg(
        flags.count_if(c("is_legal")).alias("balls"),
        flags.total(c("runs_total")).alias("runs"),
        flags.total(c("team_wickets")).alias("wickets"),
        flags.count_if(c("is_bowler_dot")).alias("dots"),
        flags.count_if(c("is_four")).alias("fours"),
        flags.count_if(c("is_six")).alias("sixes"),
    )
    rows = folded.withColumn("_s", F.explode(side)).where(c("_s.team") != "")
    out = rows.groupBy(
        text.team_id(c("_s.team"), c("gender")).alias("team_id"), "format_key", "fmt",
        c("_s.side").alias("side"), "phase",
    ).agg(
        F.count(F.lit(1)).alias("innings"),
        *[flags.total(c(k)).alias(k) for k in ("balls", "runs", "wickets", "dots", "fours",
                                               "sixes")],
    )
    return out.withColumns(rates.phase_rates()).drop("fmt")


def top_batters(innings: DataFrame, gender: Column, limit: int = C.TEAM_PLAYERS) -> DataFrame:
    """Leading run scorers for each team, in its colours only."""
    c = F.col
    sums = innings.groupBy(
        text.team_id(c("team"), gender).alias("team_id"), "format_key", "person_id"
    ).agg(
        F.count(F.lit(1)).alias("innings"), flags.total(c("runs")).alias("runs"),
        flags.total(c("balls")).alias("balls"), flags.count_if(c("out")).alias("outs"),
        flags.count_if(c("runs") >= 100).alias("hundreds"),
        flags.count_if((c("runs") >= 50) & (c("runs") < 100)).alias("fifties"),
        F.max("runs").alias("highest"),
    )
    return top_per_group(sums, TEAM, (F.desc("runs"), F.asc("balls"), F.asc("person_id")), limit)


def top_bowlers(innings: DataFrame, gender: Column, limit: int = C.TEAM_PLAYERS) -> DataFrame:
    c = F.col
    sums = innings.groupBy(
        text.team_id(c("team"), gender).alias("team_id"), "format_key", "person_id"
    ).agg(
        F.count(F.lit(1)).alias("innings"), flags.total(c("balls")).alias("balls"),
        flags.total(c("runs")).alias("runs_conceded"),
        flags.total(c("wickets")).alias("wickets"),
        flags.count_if(c("wickets") >= 5).alias("five_wickets"),
    )
    order = (F.desc("wickets"), F.asc("runs_conceded"), F.asc("person_id"))
    return top_per_group(sums, TEAM, order, limit)


def gender_of_key(format_key: Column) -> Column:
    return F.when(format_key.endswith("-w"), "female").otherwise("male")


def recent_matches(matches: DataFrame, limit: int = C.RECENT_MATCHES) -> DataFrame:
    rows = sides(matches).select(*TEAM, "match_id", "end_date", "outcome")
    return top_per_group(rows, TEAM, (F.desc("end_date"), F.desc("match_id")), limit)


def across_formats(records_: DataFrame) -> DataFrame:
    """First match, last match and matches of each team over all formats."""
    return records_.where(F.col("facet") == "overall").groupBy("team_id").agg(
        F.max("team").alias("team"), F.min("first_date").alias("first_match"),
        F.max("last_date").alias("last_match"),
        flags.total(F.col("matches")).alias("matches"),
    )


def gated_win_pct(records_: DataFrame, gate: int = C.THRESHOLDS.team_matches) -> DataFrame:
    """Win percentage only from enough decided matches."""
    c = F.col
    decided = c("won") + c("lost") + c("tied") + c("drawn")
    return records_.withColumns(
        {"decided": decided, "shown_win_pct": F.when(decided >= gate, c("win_pct"))}
    )


def toss_win_pcts(records_: DataFrame, gate: int = C.THRESHOLDS.team_matches) -> DataFrame:
    """Win percentages after winning and losing the toss.

    Decided matches after losing it are the rest of the record, which only
    holds when every match has a toss and every won toss a decision.
    """
    c = F.col
    decided = c("won") + c("lost") + c("tied") + c("drawn")
    pick = lambda f, s, v: F.coalesce(
        F.max(F.when((c("facet") == f) & (c("subject") == s), v)), F.lit(0).cast("bigint"))
    raw = lambda s: F.max(F.when((c("facet") == "toss") & (c("subject") == s), c("win_pct")))
    rows = records_.where(c("facet").isin("overall", "toss", "decision")).groupBy(*TEAM).agg(
        pick("overall", "all", c("matches")).alias("matches"),
        pick("overall", "all", decided).alias("decided"),
        pick("toss", "won", c("matches")).alias("toss_won"),
        pick("toss", "lost", c("matches")).alias("toss_lost"),
        (pick("decision", "bat", c("matches")) + pick("decision", "field", c("matches")))
        .alias("decisions"),
        (pick("decision", "bat", decided) + pick("decision", "field", decided))
        .alias("decided_won"),
        raw("won").alias("_won_pct"), raw("lost").alias("_lost_pct"),
    )
    complete = (c("toss_won") + c("toss_lost") == c("matches")) & (c("decisions") == c("toss_won"))
    return rows.withColumns(
        {
            "won_toss_pct": F.when(c("decided_won") >= gate, c("_won_pct")),
            "lost_toss_pct": F.when(
                complete & (c("decided") - c("decided_won") >= gate), c("_lost_pct")),
        }
    ).drop("_won_pct", "_lost_pct")
