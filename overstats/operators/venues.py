"""Grounds: keys that tell namesakes apart, countries, and scoring context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overstats.functions import flags, geography, rates


def _most_common(rows: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """The most frequent value per key, alphabetical on a tie.

    Counting folds a busy ground to one row per value before anything moves.
    """
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    # min over (-n, value) is the most frequent, then the first by name.
    return counts.groupBy(key).agg(
        F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_best")
    ).select(key, F.col("_best.v").alias(into))


def ground_cities(matches: DataFrame) -> DataFrame:
    """Per ground: is its name used in several cities, and its usual city."""
    rows = matches.select(
        geography.canonical_venue(F.col("venue")).alias("ground"), F.trim("city").alias("raw")
    ).where(F.col("ground") != "")
    rows = rows.withColumn("city", geography.normal_city(F.col("ground"), F.col("raw")))
    named = rows.where(F.col("city") != "")
    spread = named.select("ground", "city").distinct().groupBy("ground").agg(
        (F.count(F.lit(1)) > 1).alias("ambiguous")
    )
    usual = _most_common(named, "ground", "city", "usual_city")
    loose = _most_common(
        rows.where((F.col("city") == "") & (F.coalesce("raw", F.lit("")) != "")),
        "ground", "raw", "loose_city",
    )
    base = rows.select("ground").distinct()
    out = base.join(spread, "ground", "left").join(usual, "ground", "left").join(
        loose, "ground", "left"
    )
    return out.select(
        "ground", F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), "usual_city",
        "loose_city",
    )


def with_venue_key(matches: DataFrame, grounds: DataFrame) -> DataFrame:
    """A ground's key: its name, with the city where the name is shared."""
    ground = geography.canonical_venue(F.col("venue"))
    rows = matches.withColumns(
        {"ground": ground, "_city": geography.normal_city(ground, F.col("city"))}
    )
    joined = rows.join(grounds.select("ground", "ambiguous"), "ground", "left")
    split = F.coalesce("ambiguous", F.lit(False)) & (F.col("_city") != "")
    return joined.withColumn(
        "venue_key",
        F.when(split, F.concat("ground", F.lit("|"), "_city")).otherwise(F.col("ground")),
    ).drop("_city", "ambiguous")


def key_cities(keys: DataFrame, grounds: DataFrame) -> DataFrame:
    """The city shown for each key; namesakes never borrow each other's."""
    rows = keys.select("venue_key").distinct().withColumns(
        {
            "ground": F.substring_index("venue_key", "|", 1),
            "_own": F.when(F.col("venue_key").contains("|"),
                           F.substring_index("venue_key", "|", -1)),
        }
    ).join(grounds, "ground", "left")
    return rows.select(
        "venue_key",
        F.coalesce(
            "_own",
            F.when(~F.coalesce("ambiguous", F.lit(False)), F.col("usual_city")),
            "loose_city", F.lit(""),
        ).alias("key_city"),
    )


def with_match_country(matches: DataFrame, grounds: DataFrame, places: DataFrame) -> DataFrame:
    """Country of each match; the ground's other matches settle a vague city."""
    named = geography.with_country(matches, places, "venue_key", "city", "_direct")
    cities = key_cities(matches, grounds)
    settled = geography.with_country(cities, places, "venue_key", "key_city", "_settled")
    out = named.drop("country").join(settled.select("venue_key", "_settled"), "venue_key", "left")
    return out.withColumn(
        "country",
        F.coalesce(F.when(F.col("_direct") != "", F.col("_direct")), "_settled", F.lit("")),
    ).drop("_direct", "_settled")


def venue_stats(matches: DataFrame) -> DataFrame:
    """Scoring at each ground and format; awarded runs don't count in the rate."""
    c = F.col
    sums = lambda f: F.aggregate(
        "innings", F.lit(0).cast("bigint"), lambda acc, i: acc + f(i).cast("bigint"))
    rows = matches.where(F.coalesce("venue_key", F.lit("")) != "").select(
        "venue_key", "format_key", "first_innings_total",
        sums(lambda i: i["runs"] - i["penalty_runs"]).alias("runs"),
        sums(lambda i: i["balls"]).alias("balls"),
        sums(lambda i: i["wickets"]).alias("wickets"),
    )
    return rows.groupBy("venue_key", "format_key").agg(
        F.count(F.lit(1)).alias("matches"),
        *[flags.total(c(k)).alias(k) for k in ("runs", "balls", "wickets")],
        F.count("first_innings_total").alias("first_innings"),
        flags.total(c("first_innings_total")).alias("first_innings_runs"),
    ).withColumns(
        {
            "runs_per_over": rates.ratio(c("runs"), c("balls"), 6),
            "balls_per_wicket": rates.ratio(c("balls"), c("wickets")),
            "first_innings_avg": rates.ratio(c("first_innings_runs"), c("first_innings")),
        }
    )


def venue_countries(matches: DataFrame) -> DataFrame:
    """The country most of a ground's matches are placed in."""
    rows = matches.where(F.coalesce("country", F.lit("")) != "")
    return _most_common(rows, "venue_key", "country", "country")
