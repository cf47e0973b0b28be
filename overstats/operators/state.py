"""Ordered, per-innings state: running score, positions, cards, partnerships.

Every window is partitioned by match (and innings), which the deliveries are
already hashed on, so these operators add sorts but no shuffle. An innings is
bounded by the document it came in; nothing here grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from overstats import config as C
from overstats.functions import flags, rates, text

INNINGS = ("match_id", "innings")


def _ordered(*keys: str):
    return Window.partitionBy(*(keys or INNINGS)).orderBy("seq")


def _before(*keys: str):
    return _ordered(*keys).rowsBetween(Window.unboundedPreceding, -1)


def _upto(*keys: str):
    return _ordered(*keys).rowsBetween(Window.unboundedPreceding, 0)


def _flag(test: Column) -> Column:
    return F.when(test, 1).otherwise(0)


def running_state(deliveries: DataFrame) -> DataFrame:
    """Legal balls including this one, and score and wickets before it."""
    zero = F.lit(0).cast("bigint")
    return deliveries.withColumns(
        {
            "ball_no": F.sum(_flag(F.col("is_legal"))).over(_upto()),
            "score_before": F.coalesce(F.sum("runs_total").over(_before()), zero),
            "wickets_before": F.coalesce(F.sum("team_wickets").over(_before()), zero),
        }
    )


def faced_before(deliveries: DataFrame) -> DataFrame:
    """Balls the striker has faced in this innings before this one."""
    return deliveries.withColumn(
        "faced_before",
        F.coalesce(
            F.sum(_flag(F.col("is_faced"))).over(_before("match_id", "innings", "batter_id")),
            F.lit(0).cast("bigint"),
        ),
    )


def appearances(deliveries: DataFrame) -> DataFrame:
    """Everyone seen batting on each ball, with their order of arrival.

    One row per (ball, person seen): the striker (rank 0) carries the ball's
    figures, then the non-striker (1), then each wicket (2 + its place).
    Position is the dense rank of a person's first row, so it needs windows
    only, never a join back.
    """
    def seen(rank, person, name, kind) -> Column:
        return F.struct(rank.alias("rank"), person.alias("person_id"), name.alias("name"),
                        kind.alias("kind"))

    c, no_kind = F.col, F.lit(None).cast("string")
    who = F.concat(
        F.array(seen(F.lit(0), c("batter_id"), c("batter"), no_kind),
                seen(F.lit(1), c("non_striker_id"), c("non_striker"), no_kind)),
        F.transform("wickets", lambda w, i: seen(i + 2, w["player_out_id"], w["player_out"],
                                                 w["kind"])),
    )
    rows = deliveries.withColumn("_who", F.explode(who)).select(
        *deliveries.columns, "_who.rank", "_who.person_id", "_who.name", "_who.kind"
    ).where(F.col("person_id") != "")
    person = Window.partitionBy("match_id", "innings", "person_id")
    arrival = Window.partitionBy("match_id", "innings").orderBy("_first")
    return rows.withColumn(
        "_first", F.min(F.struct("seq", "rank")).over(person)
    ).withColumn("position", F.dense_rank().over(arrival)).drop("_first")


def arrivals(deliveries: DataFrame) -> DataFrame:
    """Every ball with the striker's position and the balls they faced before it.

    The positions are those of :func:`appearances`, and the balls those of
    :func:`faced_before`, both by one sort of the sightings. A ball without a
    striker has no position.
    """
    c = F.col
    seen = lambda rank, person: F.struct(rank.alias("_rank"), person.alias("_person"))
    who = F.concat(
        F.array(seen(F.lit(0), c("batter_id")), seen(F.lit(1), c("non_striker_id"))),
        F.coalesce(F.transform("wickets", lambda w, i: seen(i + 2, w["player_out_id"])),
                   F.array().cast("array<struct<_rank:int,_person:string>>")),
    )
    known = F.coalesce(c("_person") != "", F.lit(False))
    rows = deliveries.select(*deliveries.columns, F.inline(who)).where((c("_rank") == 0) | known)
    person = Window.partitionBy("match_id", "innings", "_person").orderBy("seq", "_rank")
    upto = person.rowsBetween(Window.unboundedPreceding, 0)
    before = person.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "_first": F.when(known, F.first(F.struct("seq", "_rank")).over(upto)),
            "faced_before": F.coalesce(
                F.sum(_flag((c("_rank") == 0) & c("is_faced"))).over(before),
                F.lit(0).cast("bigint"),
            ),
        }
    )
    arrival = Window.partitionBy("match_id", "innings").orderBy(F.asc_nulls_last("_first"))
    return rows.withColumn("position", F.when(known, F.dense_rank().over(arrival))).where(
        c("_rank") == 0
    ).drop("_rank", "_person", "_first")


def replay_states(deliveries: DataFrame, max_balls: Column) -> DataFrame:
    """State after every ball of the first two innings, as a feed reports it."""
    played = F.col("played_no") if "played_no" in deliveries.columns else F.col("innings")
    return deliveries.where(played <= 2).select(
        "match_id", "format_key", "innings", "seq", "target",
        (max_balls - F.sum(_flag(F.col("is_legal"))).over(_upto())).alias("balls_left"),
        F.sum("team_wickets").over(_upto()).alias("wickets"),
        (F.sum("runs_total").over(_upto()) + F.col("penalty_pre")).alias("runs"),
    )


def timeline(deliveries: DataFrame) -> DataFrame:
    """Labels and running totals after each ball.

    A ball's label is over.number; a wide repeats the number. Overs are
    contiguous runs of the same over number.
    """
    # A new run of an over number restarts the count within the over.
    moved = F.lag("over").over(_ordered()) != F.col("over")
    rows = deliveries.withColumn("_moved", _flag(F.coalesce(moved, F.lit(False)))).withColumn(
        "_stretch", F.sum("_moved").over(_upto())
    )
    inside = Window.partitionBy("match_id", "innings", "_stretch").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, -1
    )
    number = F.coalesce(F.sum(_flag(F.col("is_legal"))).over(inside), F.lit(0)) + 1
    return rows.withColumns(
        {
            "label": F.concat(F.col("over").cast("string"), F.lit("."), number.cast("string")),
            "legal_balls": F.sum(_flag(F.col("is_legal"))).over(_upto()),
            "score": F.sum("runs_total").over(_upto()) + F.col("penalty_pre"),
            "wickets_down": F.sum("team_wickets").over(_upto()),
        }
    ).drop("_stretch", "_moved")


def cursors(deliveries: DataFrame) -> DataFrame:
    """Number the balls of a match from 1 across innings."""
    return deliveries.withColumn(
        "cursor", F.row_number().over(Window.partitionBy("match_id").orderBy("innings", "seq"))
    )


def scoreboard(deliveries: DataFrame, ball_limit: Column) -> DataFrame:
    """Scoreboard at every cursor: rates, need, balls left, who is at the crease.

    ``ball_limit`` is the balls available in the innings (null for Tests).
    After an innings' last ball only the batters it did not dismiss remain.
    """
    c = F.col
    match = Window.partitionBy("match_id").orderBy("cursor")
    nxt = lambda name: F.lead(name).over(_ordered())
    rows = timeline(cursors(deliveries)).withColumns(
        {
            "innings_complete": nxt("seq").isNull(),
            "match_complete": F.lead("cursor").over(match).isNull(),
            "_next_over": nxt("over"),
            "_next_batter": nxt("batter_id"),
            "_next_other": nxt("non_striker_id"),
            "_next_bowler": nxt("bowler_id"),
            "_limit": ball_limit,
            "_gone": F.transform("wickets", lambda w: w["player_out_id"]),
        }
    )

    def crease(now: str, then: str) -> Column:
        left = F.when(~F.array_contains("_gone", c(now)), c(now))
        return F.when(~c("innings_complete"), c(then)).otherwise(left)

    left = F.when(c("_limit").isNotNull(), F.greatest(F.lit(0), c("_limit") - c("legal_balls")))
    need = F.when(c("target").isNotNull(), F.greatest(F.lit(0), c("target") - c("score")))
    return rows.select(
        "match_id", "innings", "seq", "cursor", "batting_team", c("score").alias("runs"),
        c("wickets_down").alias("wickets"), "legal_balls",
        text.overs_notation(c("legal_balls")).alias("overs"),
        rates.ratio(c("score"), c("legal_balls"), 6).alias("run_rate"),
        "target", need.alias("need"), left.alias("balls_left"),
        F.when((left > 0) & (need > 0), F.lit(6.0) * need / left).alias("required_rate"),
        flags.phase_of(c("fmt"), F.coalesce("_next_over", "over")).alias("phase"),
        crease("batter_id", "_next_batter").alias("striker_id"),
        crease("non_striker_id", "_next_other").alias("non_striker_id"),
        F.coalesce("_next_bowler", "bowler_id").alias("bowler_id"),
        "innings_complete", "match_complete",
    )


def over_boundaries(deliveries: DataFrame) -> DataFrame:
    """Cursor of each over's first ball, with its neighbours'."""
    starts = cursors(deliveries).groupBy("match_id", "innings", "over").agg(
        (F.min("cursor") - 1).alias("start_cursor"), F.max("cursor").alias("end_cursor")
    )
    order = Window.partitionBy("match_id").orderBy("start_cursor")
    return starts.withColumns(
        {
            "previous_start": F.lag("start_cursor").over(order),
            "next_start": F.coalesce(F.lead("start_cursor").over(order), F.col("end_cursor")),
        }
    )


def until(deliveries: DataFrame, cursor: Column | int) -> DataFrame:
    """The balls up to a cursor: the prefix every card can be drawn from."""
    return cursors(deliveries).where(F.col("cursor") <= cursor).drop("cursor")


def batting_innings(deliveries: DataFrame) -> DataFrame:
    """One row per batter's innings, faced or not.

    A retirement is shown only while the batter has not come back; any real
    dismissal, at either end, ends the innings and the last one is shown.
    """
    rows = appearances(deliveries)
    c = F.col
    facing = c("rank") == 0
    real = c("kind").isNotNull() & flags.is_dismissal(c("kind"))
    retired = c("kind").isNotNull() & ~flags.is_dismissal(c("kind"))
    at = F.struct("seq", "rank")
    when_real = F.when(real, at)
    innings = rows.groupBy("match_id", "innings", "person_id").agg(
        F.min("position").alias("position"),
        *[F.first(x).alias(x) for x in ("format_key", "fmt", "date", "batting_team",
                                        "bowling_team", "venue", "country", "chasing")],
        F.max_by("name", at).alias("name"),
        flags.total(F.when(facing, c("runs_batter"))).alias("runs"),
        flags.count_if(facing & c("is_faced")).alias("balls"),
        flags.count_if(facing & c("is_four")).alias("fours"),
        flags.count_if(facing & c("is_six")).alias("sixes"),
        F.max(F.coalesce(real, F.lit(False))).alias("out"),
        flags.count_if(real & (c("person_id") != c("batter_id"))).alias("outs_other_end"),
        F.max_by("kind", when_real).alias("_how"),
        F.max_by(F.when(flags.bowler_credited(c("kind")), c("bowler_id")).otherwise(""),
                 when_real).alias("_by"),
        F.max_by(F.when(flags.bowler_credited(c("kind")), c("bowler")).otherwise(""),
                 when_real).alias("_by_name"),
        F.max(F.when(retired, c("seq"))).alias("_retired_at"),
        F.max_by("kind", F.when(retired, at)).alias("_retired_how"),
        F.max("seq").alias("_last_seen"),
    )
    how = F.when(c("out"), c("_how")).when(
        c("_retired_at") >= c("_last_seen"), c("_retired_how")
    ).otherwise("")
    return innings.withColumns(
        {
            "dismissal": F.coalesce(how, F.lit("")),
            "dismissed_by_id": F.coalesce(F.when(c("out"), c("_by")), F.lit("")),
            "dismissed_by": F.coalesce(F.when(c("out"), c("_by_name")), F.lit("")),
        }
    ).withColumnsRenamed({"batting_team": "team", "bowling_team": "opposition"}).drop(
        "_how", "_by", "_by_name", "_retired_at", "_retired_how", "_last_seen"
    )


def bowling_innings(deliveries: DataFrame) -> DataFrame:
    """One row per bowler per innings; a maiden is a full over conceding nothing."""
    c = F.col
    overs = deliveries.where(c("bowler_id") != "").groupBy(
        "match_id", "innings", "bowler_id", "over"
    ).agg(
        *[F.first(x).alias(x) for x in ("format_key", "fmt", "date", "batting_team",
                                        "bowling_team", "venue", "country", "bowler")],
        flags.count_if(c("is_legal")).alias("balls"),
        flags.total(c("conceded")).alias("runs"),
        flags.count_if(c("credited_kind").isNotNull()).alias("wickets"),
        flags.total(c("wides")).alias("wide_runs"),
        flags.count_if(c("wides") > 0).alias("wide_balls"),
        flags.count_if(c("noballs") > 0).alias("noball_balls"),
    )
    return overs.groupBy("match_id", "innings", F.col("bowler_id").alias("person_id")).agg(
        *[F.first(x).alias(y) for x, y in (
            ("format_key", "format_key"), ("fmt", "fmt"), ("date", "date"),
            ("bowling_team", "team"), ("batting_team", "opposition"), ("venue", "venue"),
            ("country", "country"), ("bowler", "name"))],
        *[flags.total(c(x)).alias(x) for x in ("balls", "runs", "wickets", "wide_balls",
                                               "noball_balls")],
        flags.count_if((c("runs") == 0) & (c("balls") >= 6)).alias("maidens"),
    )


def batting_card(deliveries: DataFrame, cursor: Column | int) -> DataFrame:
    """Batting rows of every innings at a cursor, with who is at the crease.

    While balls remain in the innings the next ball says who is batting;
    afterwards nobody is at the crease.
    """
    c = F.col
    rows = cursors(deliveries)
    prefix = rows.where(c("cursor") <= cursor)
    card = batting_innings(prefix.drop("cursor"))
    upcoming = rows.where(c("cursor") == cursor + 1)
    crease = upcoming.select(
        "match_id", "innings", F.lit(True).alias("_upcoming"),
        F.explode(F.array_distinct(F.array("batter_id", "non_striker_id"))).alias("person_id"),
    )
    # Someone next to bat who has not been seen yet still has a row, unless the
    # next ball opens an innings the card does not show yet.
    shown = prefix.select("match_id", "innings").distinct()
    crease = crease.join(shown, ["match_id", "innings"], "left_semi")
    out = card.join(crease, ["match_id", "innings", "person_id"], "full_outer")
    zero = {k: F.coalesce(k, F.lit(0)) for k in ("runs", "balls", "fours", "sixes")}
    label = text.dismissal_label(
        F.col("dismissal"), F.when(c("dismissed_by") != "", c("dismissed_by"))
    )
    back = F.coalesce(c("_upcoming"), F.lit(False)) & ~F.coalesce(c("out"), F.lit(False))
    return out.withColumns(
        {
            **zero,
            "out": F.coalesce("out", F.lit(False)),
            "at_crease": back & (F.coalesce("dismissal", F.lit("")) == ""),
            "dismissal_label": F.when(F.coalesce("dismissal", F.lit("")) != "", label),
        }
    ).select(
        "match_id", "innings", "person_id", "position", "runs", "balls", "fours", "sixes",
        "out", "at_crease", "dismissal_label",
    )


def bowling_card(deliveries: DataFrame, cursor: Column | int) -> DataFrame:
    card = bowling_innings(until(deliveries, cursor))
    return card.select(
        "match_id", "innings", "person_id",
        text.overs_notation(F.col("balls")).alias("overs"),
        "balls", "maidens", "runs", "wickets",
        F.col("wide_balls").alias("wides"), F.col("noball_balls").alias("noballs"),
    )


def extras_card(deliveries: DataFrame, cursor: Column | int,
                penalties: DataFrame | None = None) -> DataFrame:
    """Extras by kind per innings at a cursor, with awarded penalty runs.

    ``penalties`` has (match_id, innings, penalty_pre, penalty_post); the
    runs awarded afterwards count once the innings is complete.
    """
    rows = cursors(deliveries)
    size = F.count(F.lit(1)).over(Window.partitionBy("match_id", "innings"))
    prefix = rows.withColumn("_size", size).where(F.col("cursor") <= cursor)
    out = prefix.groupBy("match_id", "innings").agg(
        *[flags.total(F.col(k)).alias(k) for k in C.EXTRA_KINDS],
        (F.count(F.lit(1)) == F.first("_size")).alias("_complete"),
    )
    if penalties is not None:
        out = out.join(
            penalties.select("match_id", "innings", "penalty_pre", "penalty_post"),
            ["match_id", "innings"], "left",
        ).withColumn(
            "penalty",
            F.col("penalty") + F.coalesce("penalty_pre", F.lit(0))
            + F.when(F.col("_complete"), F.coalesce("penalty_post", F.lit(0))).otherwise(0),
        )
    total = sum((F.col(k) for k in C.EXTRA_KINDS[1:]), F.col(C.EXTRA_KINDS[0]))
    return out.withColumn("total", total).select("match_id", "innings", *C.EXTRA_KINDS, "total")


def partnerships(deliveries: DataFrame) -> DataFrame:
    """Stands between two batters.

    A change of pair, or any wicket entry on the ball before, starts a new
    one. A second real wicket on a ball, of someone not batting on it, ends a
    further stand of no balls with the one batter who survived.
    """
    c = F.col
    rows = deliveries.withColumns(
        {
            "low_id": F.least("batter_id", "non_striker_id"),
            "high_id": F.greatest("batter_id", "non_striker_id"),
            "wickets_before": F.coalesce(F.sum("team_wickets").over(_before()), F.lit(0)),
            "_fell": F.size("wickets") > 0,
        }
    )
    changed = (
        (F.lag("low_id").over(_ordered()) != c("low_id"))
        | (F.lag("high_id").over(_ordered()) != c("high_id"))
        | F.lag("_fell").over(_ordered())
    )
    rows = rows.withColumn("_new", _flag(F.coalesce(changed, F.lit(True)))).withColumn(
        "stand", F.sum("_new").over(_upto())
    )
    stands = rows.groupBy("match_id", "innings", "stand").agg(
        (F.min_by("wickets_before", "seq") + 1).alias("wicket"),
        F.first("low_id").alias("low_id"), F.first("high_id").alias("high_id"),
        flags.total(c("runs_total")).alias("runs"),
        flags.count_if(c("is_legal")).alias("balls"),
        (~F.max("_fell")).alias("unbroken"),
        F.min("seq").alias("first_seq"),
    ).drop("stand").withColumn("extra_no", F.lit(0))
    gone = F.transform("wickets", lambda w: w["player_out_id"])
    alive = F.filter(F.array("batter_id", "non_striker_id"), lambda p: ~F.array_contains(gone, p))
    fell = F.filter("wickets", lambda w: flags.is_dismissal(w["kind"]))
    seconds = rows.where((F.size(fell) > 1) & (F.size(alive) == 1)).select(
        "match_id", "innings", "seq", "wickets_before", "batter_id", "non_striker_id",
        F.get(alive, F.lit(0)).alias("_alive"), F.posexplode(fell).alias("_k", "_w"),
    ).where(
        (c("_k") > 0) & (c("_w.player_out_id") != "")
        & (c("_w.player_out_id") != c("batter_id"))
        & (c("_w.player_out_id") != c("non_striker_id"))
    ).select(
        "match_id", "innings", (c("wickets_before") + c("_k") + 1).alias("wicket"),
        F.least("_alive", "_w.player_out_id").alias("low_id"),
        F.greatest("_alive", "_w.player_out_id").alias("high_id"),
        F.lit(0).cast("bigint").alias("runs"), F.lit(0).cast("bigint").alias("balls"),
        F.lit(False).alias("unbroken"), c("seq").alias("first_seq"),
        c("_k").alias("extra_no"),
    )
    return stands.unionByName(seconds)


def fall_of_wickets(deliveries: DataFrame) -> DataFrame:
    """Number, score, batter and ball label of every real dismissal."""
    c = F.col
    fell = F.filter("wickets", lambda w: flags.is_dismissal(w["kind"]))
    return timeline(deliveries).where(c("team_wickets") > 0).select(
        "match_id", "innings", "label", "score",
        (c("wickets_down") - c("team_wickets")).alias("_before"),
        F.posexplode(fell).alias("_k", "_w"),
    ).select(
        "match_id", "innings", (c("_before") + c("_k") + 1).alias("wicket"),
        c("score").alias("runs"), c("_w.player_out_id").alias("person_id"),
        c("_w.kind").alias("kind"), "label",
    )


def worm(deliveries: DataFrame) -> DataFrame:
    """Score at each completed over (and the last ball) with wickets in between."""
    last = F.lead("seq").over(_ordered()).isNull()
    points = timeline(deliveries).withColumn("_last", last).where(
        (F.col("innings") <= 2)
        & ((F.col("is_legal") & (F.col("legal_balls") % 6 == 0)) | F.col("_last"))
    )
    # A wide after the last legal ball of an over shares its point on the axis.
    points = points.groupBy("match_id", "innings", "legal_balls").agg(
        F.max_by("score", "seq").alias("runs"), F.max_by("wickets_down", "seq").alias("wickets")
    )
    order = Window.partitionBy("match_id", "innings").orderBy("legal_balls")
    return points.withColumn(
        "wickets_in_over", F.col("wickets") - F.coalesce(F.lag("wickets").over(order), F.lit(0))
    )
