"""Match rows: innings totals, result, first-innings rule, featured order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from overstats import config as C
from overstats.functions import flags, text
from overstats.operators.ranking import top_per_group


def innings_totals(deliveries: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Totals per innings; runs awarded outside any ball are included.

    ``facts`` (see ``documents.innings_facts``) adds penalty runs, targets,
    declarations and innings without a ball.
    """
    c = F.col
    sums = deliveries.groupBy("match_id", "innings").agg(
        F.first("batting_team").alias("team"),
        flags.total(c("runs_total")).alias("runs"),
        flags.total(c("team_wickets")).alias("wickets"),
        flags.count_if(c("is_legal")).alias("balls"),
        F.first("target").cast("int").alias("target_runs"),
    )
    if facts is None:
        return sums.withColumns(
            {"penalty_runs": F.lit(0), "declared": F.lit(False),
             "target_overs": F.lit(None).cast("double"),
             "overs": text.overs_text(c("balls"))}
        )
    zero = F.lit(0).cast("bigint")
    joined = facts.join(sums.drop("team", "target_runs"), ["match_id", "innings"], "left")
    awarded = c("penalty_pre") + c("penalty_post")
    return joined.select(
        "match_id", "innings", "team", (F.coalesce("runs", zero) + awarded).alias("runs"),
        F.coalesce("wickets", zero).alias("wickets"), F.coalesce("balls", zero).alias("balls"),
        "target_runs", awarded.alias("penalty_runs"), "declared", "target_overs",
        text.overs_text(F.coalesce("balls", zero), c("balls_per_over")).alias("overs"),
    )


def match_rows(headers: DataFrame, totals: DataFrame) -> DataFrame:
    """One flat row per match, innings nested in order (at most a handful)."""
    c = F.col
    innings = totals.groupBy("match_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "innings", "team", "runs", "wickets", "balls", "overs", "declared",
            "target_runs", "target_overs", "penalty_runs"))).alias("innings")
    )
    rows = headers.join(innings, "match_id", "left").withColumns(
        {
            "result_type": text.result_type(c("winner"), c("result")),
            "result_text": text.result_text(
                c("winner"), c("result"), c("by_runs"), c("by_wickets"), c("by_innings"),
                c("method"), c("eliminator"), c("bowl_out")),
            "winner_id": F.when(c("winner").isNotNull(), text.team_id(c("winner"), c("gender"))),
            "team1_id": text.team_id(c("team1"), c("gender")),
            "team2_id": text.team_id(c("team2"), c("gender")),
            "innings": F.coalesce("innings", F.filter("innings", lambda _: F.lit(False))),
        }
    ).withColumnsRenamed({"by_runs": "margin_runs", "by_wickets": "margin_wickets"})
    return rows.withColumns(
        {
            "margin_innings": F.coalesce(c("by_innings"), F.lit(0)) != 0,
            "eliminator": F.coalesce("eliminator", "bowl_out"),
            "city": F.when(c("city") != "", c("city")),
            "country": F.when(c("country") != "", c("country")),
            "batting_first": F.get("innings", F.lit(0))["team"],
            "first_innings_total": first_innings_total(),
        }
    ).drop("result", "by_innings", "bowl_out")


def balls_available(fmt: Column) -> Column:
    """Legal balls of a full innings, null for Tests."""
    expr = None
    for key, spec in C.FORMATS.items():
        if spec["balls"]:
            test = fmt == key
            expr = F.when(test, spec["balls"]) if expr is None else expr.when(test, spec["balls"])
    return expr


def first_innings_total() -> Column:
    """The first-innings total when it says something about the ground.

    Always in a Test; otherwise only when the match was full length and the
    innings ran its course.
    """
    first = F.get("innings", F.lit(0))
    balls = balls_available(F.col("fmt"))
    full = F.col("scheduled_overs") == F.floor(balls / F.lit(6))
    over = (first["wickets"] >= 10) | (first["balls"] >= balls)
    return F.when((F.col("fmt") == "test") | (full & over), first["runs"])


def featured_ranks(matches: DataFrame, curated=C.CURATED_MATCHES) -> DataFrame:
    """Curated matches in their order, then big finals, newest first.

    Only featured rows reach the single ordered partition: a few per event.
    """
    place = F.array_position(F.array(*[F.lit(m) for m in curated]), F.col("match_id").cast("string"))
    is_final = text.is_featured_final(F.col("event_name"), F.col("event_stage"))
    rows = matches.withColumn("_place", F.when(place > 0, place)).where(
        F.col("_place").isNotNull() | is_final
    )
    # Rank within a year first so that no task orders every final at once.
    year = F.substring("start_date", 1, 4)
    rows = rows.withColumn("_block", F.when(F.col("_place").isNotNull(), "9999").otherwise(year))
    counts = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_offset", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    inside = Window.partitionBy("_block").orderBy(
        F.asc_nulls_last("_place"), F.desc("start_date"), F.desc("match_id")
    )
    return rows.withColumn("_rn", F.row_number().over(inside)).join(
        offsets.drop("_n"), "_block"
    ).withColumn("featured_rank", F.col("_offset") + F.col("_rn")).drop(
        "_place", "_block", "_rn", "_offset"
    )


def replay_selection(documents: DataFrame, curated=C.CURATED_MATCHES) -> DataFrame:
    """Documents worth a replay when not all are wanted."""
    event = F.col("info.event")
    return documents.where(
        F.col("match_id").cast("string").isin(*curated)
        | text.is_featured_final(event["name"], event["stage"])
    )


def sample_selection(matches: DataFrame, deliveries: DataFrame, teams: list[str],
                     per_format: dict[str, int], required: list[str]) -> DataFrame:
    """A fixture: required matches, then the newest between the given teams.

    Matches with two wickets on one ball are passed over.
    """
    crowded = deliveries.where(F.size("wickets") > 1).select("match_id").distinct()
    chosen = F.col("match_id").cast("string").isin(*required)
    among = F.size(F.array_except(F.array("team1", "team2"), F.array(*[F.lit(t) for t in teams])))
    pool = matches.where(~chosen & (among == 0)).join(crowded, "match_id", "left_anti")
    must = matches.where(chosen)
    held = must.groupBy("fmt").agg(F.count(F.lit(1)).alias("_held"))
    quota = F.coalesce(
        F.try_element_at(
            F.create_map(*[F.lit(x) for kv in per_format.items() for x in kv]), F.col("fmt")),
        F.lit(0),
    )
    ranked = top_per_group(
        pool, ("fmt",), (F.desc("end_date"), F.desc("match_id")), max(per_format.values())
    )
    newest = ranked.join(held, "fmt", "left").where(
        F.col("rank") <= quota - F.coalesce("_held", F.lit(0))
    )
    return must.select("match_id", "fmt").unionByName(newest.select("match_id", "fmt")).distinct()


def format_summary(deliveries: DataFrame, players: DataFrame) -> DataFrame:
    """The manifest's figures for each format key.

    ``players`` has one (person_id, format_key) row per person seen.
    """
    per_match = deliveries.groupBy("format_key", "match_id").agg(
        F.count(F.lit(1)).alias("_balls"), F.min("date").alias("_date"),
        F.min("venue_key").alias("_venue"),
    )
    sums = per_match.groupBy("format_key").agg(
        F.count(F.lit(1)).alias("matches"), flags.total(F.col("_balls")).alias("deliveries"),
        F.count_distinct(F.when(F.col("_venue") != "", F.col("_venue"))).alias("venues"),
        F.min(F.when(F.col("_date") != "", F.col("_date"))).alias("first_date"),
        F.max(F.when(F.col("_date") != "", F.col("_date"))).alias("last_date"),
    )
    people = players.groupBy("format_key").agg(F.count(F.lit(1)).alias("players"))
    return sums.join(people, "format_key", "left")


def volume_by_gender(summary: DataFrame) -> DataFrame:
    """Women's volume as a share of men's, per format and in all."""
    split = summary.withColumns(
        {"fmt": F.substring_index("format_key", "-", 1),
         "side": F.substring_index("format_key", "-", -1)}
    )
    wide = split.groupBy("fmt").pivot("side", ["m", "w"]).agg(
        F.sum("matches").alias("matches"), F.sum("deliveries").alias("deliveries")
    )
    sums = wide.rollup("fmt").agg(
        *[F.sum(k).alias(k) for k in ("m_matches", "w_matches", "m_deliveries", "w_deliveries")])
    share = lambda k: F.when(F.col(f"m_{k}") > 0, F.lit(100.0) * F.col(f"w_{k}") / F.col(f"m_{k}"))
    return sums.select(
        F.coalesce("fmt", F.lit("all")).alias("fmt"), "m_matches", "w_matches", "m_deliveries",
        "w_deliveries", share("matches").alias("matches_pct"),
        share("deliveries").alias("deliveries_pct"),
    )
