"""Grounds, cities, countries and home sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overstats import config as C
from overstats.functions.text import text_lookup


def canonical_venue(name: Column) -> Column:
    """The ground: everything before the first comma."""
    return F.trim(F.substring_index(F.coalesce(name, F.lit("")), ",", 1))


def normal_city(ground: Column, city: Column) -> Column:
    """The ground's city, '' when unknown or only a region."""
    bare = F.trim(F.coalesce(city, F.lit("")))
    for (at, old), new in C.GROUND_CITY_ALIASES.items():
        bare = F.when((ground == at) & (bare == old), new).otherwise(bare)
    bare = text_lookup(bare, C.CITY_ALIASES, bare)
    return F.when(bare.isin(*C.REGIONS), "").otherwise(bare)


def home_countries(team: Column) -> Column:
    """Countries a team calls home, null for a team without one."""
    own = [name for name, homes in C.TEAM_HOMES.items() if homes == (name,)]
    expr = F.when(team.isin(*own), F.array(team))
    for name, homes in C.TEAM_HOMES.items():
        if homes != (name,):
            expr = expr.when(team == name, F.array(*[F.lit(h) for h in homes]))
    return expr


def home_flag(team: Column, country: Column) -> Column:
    """'home' or 'away' for a player's split, '' when it can't be told."""
    homes = home_countries(team)
    known = (F.coalesce(country, F.lit("")) != "") & homes.isNotNull()
    return F.when(
        known, F.when(F.array_contains(homes, country), "home").otherwise("away")
    ).otherwise("")


def venue_type(team: Column, opponent: Column, country: Column) -> Column:
    """'home', 'away', 'neutral' or 'unknown' for a team's record."""
    homes, theirs = home_countries(team), home_countries(opponent)
    known = (F.coalesce(country, F.lit("")) != "") & homes.isNotNull()
    return (
        F.when(~known, "unknown")
        .when(F.array_contains(homes, country), "home")
        .when(theirs.isNull(), "unknown")
        .when(F.array_contains(theirs, country), "away")
        .otherwise("neutral")
    )


def country_matches(country: Column, teams: Column) -> Column:
    """Is a metadata country one of the teams (array) a player played for?"""
    bare = F.trim(F.coalesce(country, F.lit("")))
    team = text_lookup(bare, C.COUNTRY_TEAMS, bare)
    return F.coalesce((bare != "") & F.array_contains(teams, team), F.lit(False))


def with_country(df: DataFrame, places: DataFrame, venue: str = "venue", city: str = "city",
                 into: str = "country") -> DataFrame:
    """Look a match's country up by (ground, city), then ground, then city.

    ``places`` (ground, city, country) holds exact rules; a blank ground or
    city means the rule does not depend on it. It is a parameter so that a
    user brings their own gazetteer; joins are left to adaptive planning.
    Rules that repeat count once; of two countries the first by name is taken.
    """
    rules = places.select(
        F.coalesce("ground", F.lit("")).alias("ground"),
        F.coalesce("city", F.lit("")).alias("rule_city"),
        F.col("country").alias("found"),
    ).groupBy("ground", "rule_city").agg(F.min("found").alias("found"))
    both = rules.where("ground <> '' AND rule_city <> ''")
    ground_only = rules.where("ground <> '' AND rule_city = ''").drop("rule_city")
    city_only = rules.where("ground = ''").drop("ground")
    venue_name = canonical_venue(F.col(venue))
    parts = df.withColumns(
        {
            "_ground": F.substring_index(venue_name, "|", 1),
            "_raw": F.coalesce(
                F.when(F.trim(city) != "", F.trim(city)),
                F.when(venue_name.contains("|"), F.substring_index(venue_name, "|", -1)),
                F.lit(""),
            ),
        }
    ).withColumn("_city", normal_city(F.col("_ground"), F.col("_raw")))

    def lookup(left: DataFrame, right: DataFrame, on: dict[str, str], name: str) -> DataFrame:
        right = right.select(*[F.col(r).alias(f"_k_{r}_{name}") for r in on.values()],
                             F.col("found").alias(name))
        cond = None
        for l, r in on.items():
            test = F.col(l) == F.col(f"_k_{r}_{name}")
            cond = test if cond is None else cond & test
        return left.join(right, cond, "left").drop(*[f"_k_{r}_{name}" for r in on.values()])

    out = lookup(parts, both, {"_ground": "ground", "_city": "rule_city"}, "_c1")
    out = lookup(out, ground_only, {"_ground": "ground"}, "_c2")
    out = lookup(out, city_only, {"_city": "rule_city"}, "_c3")
    out = lookup(out, city_only, {"_raw": "rule_city"}, "_c4")
    return out.withColumn(
        into, F.coalesce("_c1", "_c2", "_c3", "_c4", F.lit(""))
    ).drop("_ground", "_raw", "_city", "_c1", "_c2", "_c3", "_c4")
