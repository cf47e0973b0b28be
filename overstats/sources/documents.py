"""Nested match documents: scan, land, flatten to one row per delivery."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from overstats.functions import flags, geography, text

#: The document, spelt out: inference would turn map keys (names) into fields.
MATCH_DDL = """
info STRUCT<
  dates: ARRAY<STRING>, gender: STRING, match_type: STRING, season: STRING,
  venue: STRING, city: STRING, overs: INT, balls_per_over: INT, match_type_number: INT,
  teams: ARRAY<STRING>, players: MAP<STRING, ARRAY<STRING>>,
  registry: STRUCT<people: MAP<STRING, STRING>>,
  toss: STRUCT<winner: STRING, decision: STRING>,
  outcome: STRUCT<winner: STRING, result: STRING, method: STRING, eliminator: STRING,
    bowl_out: STRING, by: STRUCT<runs: INT, wickets: INT, innings: INT>>,
  event: STRUCT<name: STRING, stage: STRING, match_number: INT, `group`: STRING>,
  player_of_match: ARRAY<STRING>, missing: ARRAY<STRING>>,
innings ARRAY<STRUCT<
  team: STRING, super_over: BOOLEAN, declared: BOOLEAN,
  target: STRUCT<runs: INT, overs: DOUBLE>,
  penalty_runs: STRUCT<pre: INT, post: INT>,
  overs: ARRAY<STRUCT<over: INT, deliveries: ARRAY<STRUCT<
    batter: STRING, bowler: STRING, non_striker: STRING,
    runs: STRUCT<batter: INT, extras: INT, total: INT>,
    extras: MAP<STRING, INT>,
    wickets: ARRAY<STRUCT<kind: STRING, player_out: STRING>>>>>>>>
"""


def match_id_of(file_name: Column) -> Column:
    """A match's id is its file's name up to the first dot: 123.json, and 123.r2.json for a revision."""
    return F.substring_index(file_name, ".", 1)


def with_format(documents: DataFrame) -> DataFrame:
    """Gender and format key of each document."""
    gender = F.coalesce("info.gender", F.lit("male"))
    return documents.withColumns({"gender": gender, "format_key": text.format_key(F.col("fmt"), gender)})


def latest_revision(documents: DataFrame) -> DataFrame:
    """The newest file of each match.

    The document travels through a keyed maximum, which keeps one per match
    in each task before the shuffle.
    """
    rest = [c for c in documents.columns if c != "match_id"]
    newest = F.max_by(F.struct(*rest), F.struct("modified_at", "file_name"))
    return documents.groupBy("match_id").agg(newest.alias("_d")).select("match_id", "_d.*")


def read_documents(spark: SparkSession, path: str, fmt: str | None = None,
                   gender: str | Iterable[str] | None = None,
                   limit: int | None = None) -> DataFrame:
    """One row per match: its newest readable file, with the id taken from the file name.

    ``fmt`` is needed unless the folder is partitioned by ``fmt``. The newest file says what a match is: ``gender`` is asked
    of it, and ``limit`` counts matches in order of their ids after that. Which matches have several files is seen in the
    listing of the folder; only their documents are shuffled.
    """
    options = {"recursiveFileLookup": fmt is not None, "pathGlobFilter": "*.json"}
    docs = (
        spark.read.schema(f"{MATCH_DDL}, _corrupt STRING")
        .options(**options)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
        .withColumns(
            {
                "match_id": match_id_of(F.col("_metadata.file_name")),
                "modified_at": F.col("_metadata.file_modification_time"),
                "file_name": F.col("_metadata.file_name"),
            }
        )
        .where(F.col("_corrupt").isNull() & F.col("info").isNotNull())
        .drop("_corrupt")
    )
    if fmt is not None:
        docs = docs.withColumn("fmt", F.lit(fmt))
    files = spark.read.format("binaryFile").options(**options).load(path).select(  # the listing alone
        match_id_of(F.element_at(F.split("path", "/"), -1)).alias("match_id"))
    revised = files.groupBy("match_id").count().where("count > 1").select("match_id")
    if not revised.isEmpty():
        several = latest_revision(docs.join(revised, "match_id", "left_semi"))
        docs = docs.join(revised, "match_id", "left_anti").unionByName(several)
    if gender is not None:
        wanted = [gender] if isinstance(gender, str) else list(gender)
        docs = docs.where(F.col("info.gender").isin(*wanted))
    docs = with_format(docs.drop("file_name"))
    if limit is not None:  # ids are chosen before documents are moved
        chosen = docs.select("match_id").orderBy("match_id").limit(limit)
        docs = docs.join(chosen, "match_id", "left_semi")
    return docs


def land_documents(documents: DataFrame, path: str) -> None:
    """Compact the many small files once, so later jobs skip and prune."""
    documents.write.mode("overwrite").partitionBy("format_key").parquet(path)


def _person(people: Column, name: Column) -> Column:
    """Registry id; a name without one is marked so it can't hit a real id."""
    return F.when(F.coalesce(name, F.lit("")) == "", "").otherwise(
        F.coalesce(F.try_element_at(people, name), F.concat(F.lit("~"), name))
    )


def played_innings(documents: DataFrame) -> DataFrame:
    """One row per innings, super overs left out but still numbered."""
    return (
        documents.select("*", F.posexplode("innings").alias("_pos", "inn"))
        .where(~F.coalesce("inn.super_over", F.lit(False)))
        .withColumns(
            {
                "innings": F.col("_pos") + 1,
                "played_no": F.row_number().over(
                    Window.partitionBy("match_id").orderBy("_pos")
                ),
            }
        )
        .drop("_pos")
    )


def flatten(documents: DataFrame) -> DataFrame:
    """Documents to flagged deliveries.

    The one shuffle is by match, done while rows are still whole documents;
    every window and per-match group afterwards reuses that partitioning.
    A document is one row, so no match can outgrow the row it came in.
    """
    info = F.col("info")
    innings = played_innings(documents.repartition("match_id"))
    batting = F.coalesce(F.col("inn.team"), F.lit(""))
    bowling = F.coalesce(F.get(F.filter(info["teams"], lambda t: t != batting), F.lit(0)), F.lit(""))
    head = innings.select(
        "match_id", "fmt", "gender", "format_key", "innings", "played_no",
        F.coalesce(F.get(info["dates"], F.lit(0)), F.lit("")).alias("date"),
        F.coalesce(info["season"], F.lit("")).alias("season"),
        F.coalesce(info["venue"], F.lit("")).alias("venue"),
        F.coalesce(info["city"], F.lit("")).alias("city"),
        *[F.col(c) for c in ("venue_key", "country") if c in documents.columns],
        batting.alias("batting_team"), bowling.alias("bowling_team"),
        F.col("inn.target.runs").alias("target"),
        F.coalesce("inn.penalty_runs.pre", F.lit(0)).alias("penalty_pre"),
        info["registry"]["people"].alias("_people"),
        F.posexplode("inn.overs").alias("_over_pos", "_over"),
    )
    for name, default in (("venue_key", geography.canonical_venue(F.col("venue"))),
                          ("country", F.lit(""))):
        if name not in head.columns:
            head = head.withColumn(name, default)
    balls = head.select(
        "*", F.col("_over.over").alias("over"),
        F.posexplode("_over.deliveries").alias("_ball_pos", "_b"),
    )
    people, ball = F.col("_people"), F.col("_b")
    rows = balls.select(
        "match_id", "fmt", "gender", "format_key", "date", "season", "venue", "venue_key",
        "city", "country", "innings", "played_no", "batting_team", "bowling_team", "target",
        "penalty_pre", "over", (F.col("_ball_pos") + 1).alias("ball_in_over"),
        "_over_pos", "_ball_pos",
        *[F.coalesce(ball[n], F.lit("")).alias(n) for n in ("batter", "non_striker", "bowler")],
        *[_person(people, ball[n]).alias(f"{n}_id") for n in ("batter", "non_striker", "bowler")],
        *[F.coalesce(ball["runs"][s], F.lit(0)).alias(f"runs_{n}")
          for s, n in (("batter", "batter"), ("extras", "extras"), ("total", "total"))],
        *[v.alias(k) for k, v in flags.extras_by_kind(ball["extras"]).items()],
        F.transform(
            F.coalesce(ball["wickets"], F.array().cast("array<struct<kind:string,player_out:string>>")),
            lambda w: F.struct(
                F.coalesce(w["kind"], F.lit("")).alias("kind"),
                F.coalesce(w["player_out"], F.lit("")).alias("player_out"),
                _person(people, w["player_out"]).alias("player_out_id"),
            ),
        ).alias("wickets"),
    )
    order = Window.partitionBy("match_id", "innings").orderBy("_over_pos", "_ball_pos")
    chasing = F.when(F.col("fmt") == "test", F.col("played_no") == 4).otherwise(
        F.col("target").isNotNull()
    )
    rows = rows.withColumns(
        {
            "seq": F.row_number().over(order),
            "chasing": chasing,
            "phase": flags.phase_of(F.col("fmt"), F.col("over")),
            "year": F.substring("date", 1, 4),
        }
    ).drop("_over_pos", "_ball_pos")
    return flags.with_flags(rows)


def headers(documents: DataFrame) -> DataFrame:
    """Match facts other than the deliveries, one flat row per match."""
    info = F.col("info")
    outcome = info["outcome"]
    return documents.select(
        "match_id", "fmt", "gender", "format_key",
        F.coalesce(F.get(info["dates"], F.lit(0)), F.lit("")).alias("start_date"),
        F.coalesce(F.try_element_at(info["dates"], F.lit(-1)), F.lit("")).alias("end_date"),
        F.coalesce(info["season"], F.lit("")).alias("season"),
        info["event"]["name"].alias("event_name"),
        info["event"]["stage"].alias("event_stage"),
        info["event"]["match_number"].alias("event_match_number"),
        info["event"]["group"].alias("event_group"),
        info["match_type_number"].alias("match_type_number"),
        F.coalesce(info["venue"], F.lit("")).alias("venue"),
        F.coalesce(info["city"], F.lit("")).alias("city"),
        F.get(info["teams"], F.lit(0)).alias("team1"),
        F.try_element_at(info["teams"], F.lit(2)).alias("team2"),
        info["toss"]["winner"].alias("toss_winner"),
        info["toss"]["decision"].alias("toss_decision"),
        outcome["winner"].alias("winner"),
        outcome["result"].alias("result"),
        outcome["method"].alias("method"),
        outcome["eliminator"].alias("eliminator"),
        outcome["bowl_out"].alias("bowl_out"),
        outcome["by"]["runs"].alias("by_runs"),
        outcome["by"]["wickets"].alias("by_wickets"),
        outcome["by"]["innings"].alias("by_innings"),
        info["overs"].alias("scheduled_overs"),
        F.transform(
            F.coalesce(info["player_of_match"], F.array().cast("array<string>")),
            lambda n: F.struct(
                F.try_element_at(info["registry"]["people"], n).alias("id"), n.alias("name")
            ),
        ).alias("player_of_match"),
        text.missing_fields(info["missing"]).alias("missing"),
        has_deliveries(F.col("innings")).alias("has_replay"),
    )


def has_deliveries(innings: Column) -> Column:
    return F.coalesce(
        F.exists(
            innings,
            lambda i: ~F.coalesce(i["super_over"], F.lit(False))
            & F.exists(i["overs"], lambda o: F.size(o["deliveries"]) > 0),
        ),
        F.lit(False),
    )


def innings_facts(documents: DataFrame) -> DataFrame:
    """Per-innings facts that belong to no ball."""
    inn = F.col("inn")
    return played_innings(documents).select(
        "match_id", "innings", "played_no", F.coalesce(inn["team"], F.lit("")).alias("team"),
        F.coalesce(inn["declared"], F.lit(False)).alias("declared"),
        inn["target"]["runs"].alias("target_runs"),
        inn["target"]["overs"].alias("target_overs"),
        F.coalesce(inn["penalty_runs"]["pre"], F.lit(0)).alias("penalty_pre"),
        F.coalesce(inn["penalty_runs"]["post"], F.lit(0)).alias("penalty_post"),
        F.coalesce(F.col("info.balls_per_over"), F.lit(6)).alias("balls_per_over"),
    )


def squads(documents: DataFrame) -> DataFrame:
    """One row per listed player: (match, team, name, person)."""
    people = F.col("info.registry.people")
    return documents.select(
        "match_id", "format_key", "gender", F.coalesce(F.get("info.dates", F.lit(0)), F.lit("")).alias("date"),
        people.alias("_people"), F.explode("info.players").alias("team", "_names"),
    ).select(
        "match_id", "format_key", "gender", "date", "team", "_people",
        F.explode("_names").alias("name"),
    ).select(
        "match_id", "format_key", "gender", "date", "team", "name",
        _person(F.col("_people"), F.col("name")).alias("person_id"),
    )


def registry(documents: DataFrame) -> DataFrame:
    """Every (match, name, person) of the registry, officials included."""
    return documents.select(
        "match_id", "format_key", F.coalesce(F.get("info.dates", F.lit(0)), F.lit("")).alias("date"),
        F.coalesce(F.try_element_at("info.dates", F.lit(-1)), F.lit("")).alias("end_date"),
        F.explode("info.registry.people").alias("name", "person_id"),
    )
