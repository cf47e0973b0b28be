"""Document-shaped outputs: player, team and replay records, indexes, manifest."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from overstats import config as C
from overstats.functions import text


def replay_documents(deliveries: DataFrame, matches: DataFrame, people: DataFrame | None = None
                     ) -> DataFrame:
    """One nested row per match: innings in order, each with its balls in order.

    Balls are named structs. Collecting is bounded by the match, and the
    deliveries are already partitioned by it.
    """
    c = F.col
    ball = F.struct(
        "seq", "over", "ball_in_over", "batter_id", "bowler_id", "non_striker_id", "runs_batter",
        "runs_extras", *C.EXTRA_KINDS,
        F.transform("wickets", lambda w: F.struct(
            w["kind"].alias("kind"), w["player_out_id"].alias("player_out_id"))).alias("wickets"),
    )
    innings = deliveries.groupBy("match_id", "innings").agg(
        F.first("batting_team").alias("team"), F.first("target").cast("int").alias("target"),
        F.first("penalty_pre").alias("penalty_pre"), F.sort_array(F.collect_list(ball)).alias("balls"),
    )
    nested = innings.groupBy("match_id").agg(F.sort_array(F.collect_list(
        F.struct("innings", "team", "target", "penalty_pre", "balls"))).alias("innings"))
    title = F.array_join(F.transform(F.slice("innings", 1, 2), lambda i: i["team"]), " v ")
    facts = matches.select(
        "match_id", "fmt", "format_key", "gender", "event_name",
        F.coalesce("event_stage", F.when(c("event_match_number").isNotNull(), F.concat(
            F.lit("Match "), c("event_match_number").cast("string"))), F.lit("")).alias("stage"),
        c("start_date").alias("date"), "venue", "venue_key", "city", "team1", "team2",
        "toss_winner", "toss_decision", c("result_text").alias("result"), "winner",
        "scheduled_overs", "method",
    )
    out = facts.join(nested, "match_id").withColumns(
        {"title": title, "schema_version": F.lit(C.SCHEMA_VERSION)})
    if people is None:
        return out
    roster = match_people(deliveries).join(
        people.select("person_id", "bowling_type", "batting_hand"), "person_id", "left"
    ).groupBy("match_id").agg(F.sort_array(F.collect_list(
        F.struct("team", "person_id", "name", "bowling_type", "batting_hand"))).alias("people"))
    return out.join(roster, "match_id", "left")


def match_people(deliveries: DataFrame) -> DataFrame:
    from overstats.operators.players import squads_from_deliveries

    return squads_from_deliveries(deliveries).select("match_id", "team", "person_id", "name")


def explode_replays(replays: DataFrame) -> DataFrame:
    """Replay documents back to balls, for anything that reads a stored one."""
    rows = replays.select("match_id", "format_key", "fmt", F.inline("innings"))
    return rows.select(
        "match_id", "format_key", "fmt", "innings", F.col("team").alias("batting_team"), "target",
        "penalty_pre", F.inline("balls"))


def replay_sizes(replays: DataFrame) -> DataFrame:
    """Balls stored per replay."""
    return replays.select("match_id", F.aggregate(
        "innings", F.lit(0).cast("bigint"),
        lambda acc, i: acc + F.size(i["balls"]).cast("bigint")).alias("balls"))


def write_replays(replays: DataFrame, path: str) -> None:
    replays.write.mode("overwrite").partitionBy("format_key").option(
        "compression", "gzip").json(path)


def replay_index(replays: DataFrame, ranks: DataFrame) -> DataFrame:
    """Featured replays in rank order."""
    cols = ("match_id", "fmt", "format_key", "gender", "title", "event_name", "stage", "date",
            "venue", "result")
    return replays.select(*cols).join(
        ranks.select("match_id", "featured_rank"), "match_id"
    ).orderBy("featured_rank")


def gather(sections: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per ``key`` with an array per section, each sorted, after a single shuffle of all sections' rows.

    The sections' columns other than the key are put side by side as structs, one of them filled in each row. A key's rows
    in all sections must fit a task.
    """
    shapes = {name: df.select(F.struct(*[c for c in df.columns if c != key]).alias(name)).schema[name].dataType for name, df in sections.items()}
    tagged = []
    for own, df in sections.items():
        items = F.struct(*[c for c in df.columns if c != key])
        tagged.append(df.select(key, *[(items if name == own else F.lit(None)).cast(kind).alias(name) for name, kind in shapes.items()]))
    rows = functools.reduce(DataFrame.union, tagged)
    return rows.groupBy(key).agg(*[F.sort_array(F.collect_list(name)).alias(name) for name in sections])


def player_documents(names: DataFrame, careers: DataFrame, bat_splits: DataFrame,
                     bowl_splits: DataFrame, claims: DataFrame, profiles: DataFrame) -> DataFrame:
    """One nested row per person and format of their career.

    Splits nest as arrays sorted by dimension and subject; a section without rows is empty. Tables are gathered by person in
    one shuffle, which the game bounds, and then taken apart by format.
    """
    career = [c for c in careers.columns if c not in ("person_id", "format_key")]
    sections = {
        "person": names.select("person_id", "name"), "career": careers.select("person_id", "format_key", *career),
        "batting": bat_splits.where("dimension <> 'all'").select(
            "person_id", "format_key", "dimension", "subject", "balls", "runs", "outs", "fours", "sixes", "dots"),
        "bowling": bowl_splits.where("dimension <> 'all'").select(
            "person_id", "format_key", "dimension", "subject", "balls", "runs", "wickets", "dots", "fours", "sixes"),
        "claims": claims.select("person_id", "format_key", "kind", "rank", "dimension_key", "subject", "value", "percentile", "balls", "confidence"),
        "profile": profiles.select("person_id", "format_key", "discipline", "axis", "value", "percentile", "balls"),
    }
    rows = gather(sections, "person_id").select("person_id", F.get("person", F.lit(0))["name"].alias("name"), F.inline("career"),
                                                "batting", "bowling", "claims", "profile")

    def own_part(part: str):
        fields = [f for f in sections[part].columns if f not in ("person_id", "format_key")]
        mine = F.filter(part, lambda x: x["format_key"] == F.col("format_key"))
        return F.transform(mine, lambda x: F.struct(*[x[f].alias(f) for f in fields]))

    own = {part: own_part(part) for part in ("batting", "bowling", "claims", "profile")}
    return rows.withColumns(own | {"slug": text.person_slug(F.col("name"), F.col("person_id"))})


def published_splits(splits: DataFrame, gate: int, versus: str, ranked: DataFrame) -> DataFrame:
    """Splits above the display gate; years are all kept, opponents the top forty."""
    c = F.col
    plain = splits.where((c("dimension") != versus) & ((c("dimension") == "year") | (c("balls") >= gate)))
    return plain.unionByName(ranked.select(*splits.columns))


def player_index(documents: DataFrame) -> DataFrame:
    """One small row per person, most runs in a format first."""
    c = F.col
    rows = documents.groupBy("person_id").agg(
        F.max("name").alias("name"), F.max("slug").alias("slug"),
        F.max(F.coalesce("runs", F.lit(0))).alias("best_runs"),
        F.sort_array(F.collect_list(F.struct(
            "format_key", "matches", "runs", "balls", "bat_avg", "bat_sr", "wickets", "bowl_balls",
            "bowl_avg", "bowl_econ", F.size("claims").alias("claims")))).alias("formats"),
    )
    return rows.orderBy(F.desc("best_runs"), c("name"), c("person_id"))


def team_documents(records: DataFrame, phases: DataFrame, batters: DataFrame,
                   bowlers: DataFrame, recent: DataFrame) -> DataFrame:
    """One nested row per team and format with every facet of its record."""
    keys = ["team_id", "format_key"]
    nest = lambda df, name, *cols: df.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    out = records.where("facet = 'overall'").select(
        *keys, "team", "matches", "won", "lost", "tied", "drawn", "no_result", "win_pct",
        "first_date", "last_date")
    parts = (
        nest(records.where("facet <> 'overall'"), "facets", "facet", "subject", "matches", "won",
             "lost", "tied", "drawn", "no_result", "win_pct"),
        nest(phases, "phases", "side", "phase", "innings", "balls", "runs", "wickets"),
        nest(batters, "top_batters", "rank", "person_id", "innings", "runs", "balls"),
        nest(bowlers, "top_bowlers", "rank", "person_id", "innings", "wickets", "runs_conceded"),
        nest(recent, "recent", "rank", "match_id"),
    )
    for part in parts:
        out = out.join(part, keys, "left")
    return out


def manifest(summary: DataFrame, build_id: str, generated_at: str, fingerprint: str,
             provenance: str = "live") -> DataFrame:
    """One row per format key with the facts of the build it belongs to."""
    return summary.withColumns({
        "schema_version": F.lit(C.SCHEMA_VERSION), "build_id": F.lit(build_id),
        "generated_at": F.lit(generated_at), "fingerprint": F.lit(fingerprint),
        "provenance": F.lit(provenance),
    })
