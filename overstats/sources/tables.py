"""Bind general tables to match data.

The line-item table is read as a stream of deliveries: an order block is a
match, its halves are innings, parts bat and suppliers bowl. The mapping is
one set of column expressions, so every operator can be run, checked against
plain SQL and timed on tables of any size.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from overstats.functions import flags, styles, text
from overstats.operators import state
from overstats.session import materialise, materialise_by

TEAMS = ("India", "Australia", "England", "Pakistan", "South Africa", "New Zealand",
         "West Indies", "Sri Lanka")
#: (venue, city, venue key, country) of the twelve grounds
GROUNDS = (
    ("Eden Gardens", "Kolkata", "Eden Gardens", "India"),
    ("National Stadium", "Karachi", "National Stadium|Karachi", "Pakistan"),
    ("National Stadium", "Hamilton", "National Stadium|Hamilton", "Bermuda"),
    ("Melbourne Cricket Ground", "Melbourne", "Melbourne Cricket Ground", "Australia"),
    ("County Ground", "Bristol", "County Ground|Bristol", "England"),
    ("County Ground", "Taunton", "County Ground|Taunton", "England"),
    ("Kensington Oval, Bridgetown", "Barbados", "Kensington Oval", "West Indies"),
    ("Newlands", "Cape Town", "Newlands", "South Africa"),
    ("M Chinnaswamy Stadium", "Bangalore", "M Chinnaswamy Stadium", "India"),
    ("M Chinnaswamy Stadium, Bengaluru", "Bengaluru", "M Chinnaswamy Stadium", "India"),
    ("Hagley Oval", "Christchurch", "Hagley Oval", "New Zealand"),
    ("Maple Leaf Ground", "", "Maple Leaf Ground", ""),
)
#: Distance between the numbers of a match and of those split from it: a
#: multiple of everything that match facts are counted by, so these stay.
APART = 2520 * 11 * 17 * 19 * 23 << 20
#: 1 for a ball that is neither a wide nor a no-ball
LEGAL = "CASE WHEN q % 13 <> 0 AND q % 17 <> 0 THEN 1 ELSE 0 END"
TYPE_CODES = ("rf", "rfm", "rm", "lf", "lfm", "lm", "ob", "lb", "sla", "")


def _literals(values) -> str:
    return "array(" + ", ".join("'" + v.replace("'", "\\'") + "'" for v in values) + ")"


def _pick(values, index: Column) -> Column:
    return F.element_at(F.expr(_literals(values)), (index + 1).cast("int"))


def _at(values, index: str) -> Column:
    """:func:`_pick` with the index as SQL text."""
    return F.expr(f"element_at({_literals(values)}, cast({index} + 1 as int))")


def _by(rows: Column, field: str) -> Column:
    """Structs in order of one field (maps inside them have no order)."""
    return F.array_sort(rows, lambda a, b: (a[field] - b[field]).cast("int"))


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def person(n: Column) -> Column:
    return F.concat(F.lit("p"), _two(n))


def match_columns(mixed: bool) -> dict[str, Column]:
    """Everything about a match that follows from its number."""
    fmt, gender, key = "'t20i'", "'male'", "'t20i-m'"
    if mixed:
        fmt = "CASE WHEN match_id % 5 = 3 THEN 'odi' WHEN match_id % 5 = 4 THEN 'test' ELSE 't20i' END"
        gender = "CASE WHEN match_id % 7 = 0 THEN 'female' ELSE 'male' END"
        key = f"concat({fmt}, CASE WHEN match_id % 7 = 0 THEN '-w' ELSE '-m' END)"
    return {
        "fmt": F.expr(fmt), "gender": F.expr(gender), "format_key": F.expr(key),
        "date": F.expr("concat_ws('-', string(2010 + match_id % 14), "
                       "lpad(string(1 + match_id % 12), 2, '0'), lpad(string(1 + match_id % 28), 2, '0'))"),
        "year": F.expr("string(2010 + match_id % 14)"),
        "venue": _at([g[0] for g in GROUNDS], "match_id % 12"),
        "city": _at([g[1] for g in GROUNDS], "match_id % 12"),
        "venue_key": _at([g[2] for g in GROUNDS], "match_id % 12"),
        "country": _at([g[3] for g in GROUNDS], "match_id % 12"),
        "team1": _at(TEAMS, "match_id % 8"), "team2": _at(TEAMS, "(match_id + 3) % 8"),
    }


class Tables:
    """Lazy views of one folder of tables, bound to the match model."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._held: DataFrame | None = None
        #: Tables that queries have written on the way, by name and what they are of.
        self.written: dict[tuple, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ------------------------------------------------------------------
    def balls(self) -> DataFrame:
        """Match, innings, ball number and over of every line item."""
        c = F.col
        key = c("l_orderkey")
        lines = self.table("lineitem").select(
            F.floor(key / F.lit(64.0)).alias("match_id"),
            (F.floor(key / F.lit(32.0)) % 2 + 1).cast("int").alias("innings"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
            c("l_quantity").cast("int").alias("q"),
            F.round(c("l_discount") * 100).cast("int").alias("dd"),
            F.round(c("l_tax") * 100).cast("int").alias("tt"),
        )
        order = Window.partitionBy("match_id", "innings").orderBy(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
            "q", "dd", "tt",
        )
        # Both by one sort; what ties in all these columns is the same ball.
        legal = F.sum(F.expr(LEGAL)).over(order.rowsBetween(Window.unboundedPreceding, -1))
        return lines.repartition("match_id").withColumns(
            {
                "seq": F.row_number().over(order),
                "over": F.floor(F.coalesce(legal, F.lit(0)) / F.lit(6)).cast("int"),
            }
        ).drop("l_orderkey", "l_linenumber", "l_extendedprice")

    def bound(self, mixed: bool = False) -> DataFrame:
        return self._told(mixed).drop("_legal", "l_partkey", "l_suppkey", "dd", "tt")

    def _told(self, mixed: bool = False) -> DataFrame:
        c = F.col
        who = {"batter": "l_partkey % 60", "non_striker": "(l_partkey + 7) % 60",
               "bowler": "l_suppkey % 40", "unseen": "(l_partkey % 60 + 13) % 60"}
        two = {role: f"lpad(string({n}), 2, '0')" for role, n in who.items()}

        def out(kind: str, role: str) -> str:
            return (f"struct('{kind}' AS kind, concat('Player ', {two[role]}) AS player_out, "
                    f"concat('p', {two[role]}) AS player_out_id)")

        kinds = f"""CASE
            WHEN dd = 10 AND tt < 2 THEN array({out('caught', 'batter')})
            WHEN dd = 10 AND tt = 2 THEN array({out('bowled', 'batter')})
            WHEN dd = 10 AND tt = 3 THEN array({out('lbw', 'batter')})
            WHEN dd = 10 AND tt = 4 AND q % 2 = 0 THEN array({out('run out', 'non_striker')})
            WHEN dd = 10 AND tt = 4 THEN array({out('run out', 'batter')})
            WHEN dd = 9 AND tt = 8 THEN array({out('retired hurt', 'batter')})
            WHEN dd = 9 AND tt = 7 AND q % 5 = 0
              THEN array({out('caught', 'batter')}, {out('run out', 'non_striker')})
            WHEN dd = 9 AND tt = 6 AND q % 9 = 0 THEN array({out('timed out', 'unseen')})
            ELSE cast(array() AS array<struct<kind:string,player_out:string,player_out_id:string>>) END"""
        rows = (self.balls() if self._held is None else self._held).withColumns(
            {
                **match_columns(mixed),
                "runs_batter": F.expr("CASE WHEN q % 13 = 0 OR q % 10 < 4 THEN 0 WHEN q % 10 < 7 THEN 1 "
                                      "WHEN q % 10 = 7 THEN 2 WHEN q % 10 = 8 THEN 4 ELSE 6 END"),
                "wides": F.expr("CASE WHEN q = 39 THEN 2 WHEN q % 13 = 0 THEN 1 ELSE 0 END"),
                "noballs": F.expr("CASE WHEN q % 17 = 0 AND q % 13 <> 0 THEN 1 ELSE 0 END"),
                "_legal": F.expr(LEGAL),
                "penalty": F.lit(0), "penalty_pre": F.lit(0), "penalty_post": F.lit(0),
                "wickets": F.expr(kinds),
                **{f"{r}_id": F.expr(f"concat('p', {two[r]})") for r in ("batter", "non_striker", "bowler")},
                **{r: F.expr(f"concat('Player ', {two[r]})") for r in ("batter", "non_striker", "bowler")},
            }
        ).withColumns(
            {
                "byes": F.expr("CASE WHEN _legal = 1 AND runs_batter = 0 AND q % 11 = 0 THEN 1 ELSE 0 END"),
                "legbyes": F.expr("CASE WHEN _legal = 1 AND runs_batter = 0 AND q % 21 = 0 THEN 2 ELSE 0 END"),
            }
        )
        rows = rows.withColumns(
            {
                "runs_extras": c("wides") + c("noballs") + c("byes") + c("legbyes"),
                "batting_team": F.when(c("innings") == 1, c("team1")).otherwise(c("team2")),
                "bowling_team": F.when(c("innings") == 1, c("team2")).otherwise(c("team1")),
                "played_no": c("innings"),
                "season": c("year"),
            }
        ).withColumn("runs_total", c("runs_batter") + c("runs_extras"))
        first = F.sum(F.when(c("innings") == 1, c("runs_total"))).over(
            Window.partitionBy("match_id")
        )
        rows = rows.withColumns(
            {
                "target": F.when((c("innings") == 2) & (c("fmt") != "test"), first + 1),
                "ball_in_over": F.row_number().over(
                    Window.partitionBy("match_id", "innings", "over").orderBy("seq")
                ),
                "phase": flags.phase_of(c("fmt"), c("over")),
            }
        ).withColumn("chasing", c("target").isNotNull())
        return flags.with_flags(rows)

    @cached_property
    def deliveries(self) -> DataFrame:
        """All matches as one format, so cohort gates are met at small sizes."""
        return self.bound()

    @cached_property
    def mixed(self) -> DataFrame:
        """The same balls spread over three formats and two genders."""
        return self.bound(mixed=True)

    def hold(self, mixed: bool = False, arrivals: bool = False) -> DataFrame:
        """The balls written once, by match, for queries that read them several times.

        Only their places and their own figures are written, and where asked what :func:`state.arrivals`
        tells of the striker; the rest follows from these in the row.
        """
        if self._held is None or (arrivals and "position" not in self._held.columns):
            rows = self.balls() if self._held is None else self._held
            if arrivals:
                seen = self._told().select(*rows.columns, "batter_id", "non_striker_id", "wickets", "is_faced")
                rows = state.arrivals(seen).select(*rows.columns, "position", "faced_before")
            self._held = materialise_by(rows, "balls", "match_id")
            self.__dict__.pop("deliveries", None)
            self.__dict__.pop("mixed", None)
        return self.mixed if mixed else self.deliveries

    @cached_property
    def people(self) -> DataFrame:
        """Bowling type and batting hand of every person who appears."""
        lines = self.table("lineitem")
        ids = lines.select(F.explode(F.array(F.col("l_partkey") % 60, F.col("l_suppkey") % 40)).alias("n")).distinct()
        kind = _pick(TYPE_CODES, F.col("n") % 10)
        return ids.select(
            person(F.col("n")).alias("person_id"),
            kind.alias("bowling_type"),
            styles.bowling_family(kind).alias("bowling_family"),
            F.when(F.col("n") % 3 == 0, "left").otherwise("right").alias("batting_hand"),
            F.concat(F.lit("Player "), _two(F.col("n"))).alias("name"),
            _pick(TEAMS, F.col("n") % 8).alias("country"),
            _pick(("Batter", "Bowler", "Batting all-rounder", "Wicketkeeper batter"),
                  F.col("n") % 4).alias("role"),
        )

    @cached_property
    def limited(self) -> DataFrame:
        """:meth:`legal`, written once: the model reads it several times."""
        return materialise(self.legal(), "limited")

    def legal(self) -> DataFrame:
        """Every ball in an innings of at most 120 legal balls and ten wickets, ended by its target.

        Where a limit is reached the rest becomes an innings of a match of its
        own, with the same teams, ground and day: no ball is left out.
        """
        c = F.col
        innings = Window.partitionBy("match_id", "innings")
        order = innings.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        before = lambda v: F.coalesce(F.sum(v).over(order), F.lit(0))
        legal = F.when(c("is_legal"), 1).otherwise(0)
        rows = self.deliveries.withColumns(
            {
                "_part": (F.floor(before(legal) / 120) + F.floor(before(c("team_wickets")) / 10)),
                "_score": before(c("runs_total")),
            }
        )
        first = F.sum(F.when((c("innings") == 1) & (c("_part") == 0), c("runs_total")).otherwise(0)).over(
            Window.partitionBy("match_id")
        )
        rows = rows.withColumn("target", F.when(c("innings") == 2, first + 1))
        chased = F.when(c("_score") >= c("target"), 1).otherwise(0)
        rows = rows.withColumn("_part", 2 * (2 * c("_part") + chased) + c("innings") - 1)
        apart = c("_part") >= 2
        rows = rows.withColumns(
            {
                "match_id": c("match_id") + F.when(apart, c("_part") * F.lit(APART)).otherwise(F.lit(0)),
                "innings": F.when(apart, F.lit(1)).otherwise(c("innings")),
                "played_no": F.when(apart, F.lit(1)).otherwise(c("innings")),
                "target": F.when(~apart, c("target")),
                "chasing": ~apart & (c("innings") == 2),
            }
        ).drop("_part", "_score")
        rows = rows.withColumn("over", F.floor(before(legal) / 6).cast("int"))
        number = F.row_number().over(Window.partitionBy("match_id", "innings", "over").orderBy("seq"))
        return rows.withColumns({"ball_in_over": number, "phase": flags.phase_of(c("fmt"), c("over"))})

    def headers(self, mixed: bool = False, rows: DataFrame | None = None) -> DataFrame:
        """Match facts as a document header would state them."""
        c = F.col
        totals = (self.bound(mixed) if rows is None else rows).groupBy("match_id").agg(
            flags.total(F.when(c("innings") == 1, c("runs_total"))).alias("t1"),
            flags.total(F.when(c("innings") == 2, c("runs_total"))).alias("t2"),
            flags.total(F.when(c("innings") == 2, c("team_wickets"))).alias("w2"),
            F.count_distinct("innings").alias("n"),
        )
        m = c("match_id")
        rows = totals.withColumns(match_columns(mixed))
        void = (c("n") < 2) | (m % 17 == 0)
        draw = (c("fmt") == "test") & (m % 4 == 0)
        winner = F.when(~void & ~draw & (c("t1") > c("t2")), c("team1")).when(
            ~void & ~draw & (c("t2") > c("t1")), c("team2")
        )
        return rows.select(
            "match_id", "fmt", "gender", "format_key",
            c("date").alias("start_date"), c("date").alias("end_date"),
            c("year").alias("season"),
            F.when(m % 9 == 0, "World Cup").when(m % 9 == 1, "World Cup Qualifier")
            .when(m % 9 == 2, "Asia Pacific Champions Trophy").otherwise("Tour").alias("event_name"),
            F.when(m % 3 == 0, "Final").alias("event_stage"),
            (m % 10).cast("int").alias("event_match_number"),
            F.lit(None).cast("string").alias("event_group"),
            F.lit(None).cast("int").alias("match_type_number"),
            "venue", "city", "venue_key", "country", "team1", "team2",
            F.when(m % 11 != 0, F.when(m % 2 == 0, c("team1")).otherwise(c("team2")))
            .alias("toss_winner"),
            F.when(m % 11 != 0, F.when(m % 3 == 0, "bat").otherwise("field"))
            .alias("toss_decision"),
            winner.alias("winner"),
            F.when(void, "no result").when(draw, "draw")
            .when(c("t1") == c("t2"), "tie").alias("result"),
            F.when(winner.isNotNull(), F.when(m % 19 == 0, "D/L").when(m % 23 == 0, "Awarded"))
            .alias("method"),
            F.when(~void & ~draw & (c("t1") == c("t2")), c("team1")).alias("eliminator"),
            F.lit(None).cast("string").alias("bowl_out"),
            F.when(winner.isNotNull() & (c("t1") > c("t2")) & (m % 23 != 0),
                   c("t1") - c("t2")).alias("by_runs"),
            F.when(winner.isNotNull() & (c("t2") > c("t1")) & (m % 23 != 0),
                   F.greatest(10 - c("w2"), F.lit(1).cast("bigint"))).alias("by_wickets"),
            F.when(winner.isNotNull() & (c("fmt") == "test") & (m % 6 == 1), 1)
            .alias("by_innings"),
            F.when(c("fmt") == "odi", 50).when(c("fmt") == "t20i", 20).alias("scheduled_overs"),
            F.array().cast("array<struct<id:string,name:string>>").alias("player_of_match"),
            F.array().cast("array<string>").alias("missing"),
            F.lit(True).alias("has_replay"),
        )

    def documents(self, mixed: bool = False) -> DataFrame:
        """The same matches as nested documents, as they would be landed.

        Collecting a match into its document is bounded by the match.
        """
        c = F.col
        rows = self.bound(mixed)
        extras = F.map_filter(
            F.create_map(*[x for k in ("wides", "noballs", "byes", "legbyes")
                           for x in (F.lit(k), c(k))]),
            lambda _k, v: v > 0,
        )
        ball = F.struct(
            "seq", "batter", "bowler", "non_striker",
            F.struct(c("runs_batter").alias("batter"), c("runs_extras").alias("extras"),
                     c("runs_total").cast("int").alias("total")).alias("runs"),
            extras.alias("extras"),
            F.transform("wickets", lambda w: F.struct(
                w["kind"].alias("kind"), w["player_out"].alias("player_out"))).alias("wickets"),
        )
        known = lambda name, pid: F.struct(name.alias("name"), pid.alias("id"))
        people = F.array_distinct(F.flatten(F.collect_list(F.array(*[
            known(c(r), c(f"{r}_id")) for r in ("batter", "non_striker", "bowler")]))))
        outs = F.array_distinct(F.flatten(F.collect_list(F.transform(
            "wickets", lambda w: known(w["player_out"], w["player_out_id"])))))
        overs = rows.groupBy("match_id", "innings", "over").agg(
            _by(F.collect_list(F.struct("seq", ball.alias("b"))), "seq").alias("_balls"),
            people.alias("_people"), outs.alias("_outs"),
            F.first("batting_team").alias("team"), F.first("target").alias("target"),
            *[F.first(k).alias(k) for k in ("fmt", "gender", "format_key", "date", "year",
                                            "venue", "city", "venue_key", "country", "team1",
                                            "team2")],
        )
        innings = overs.groupBy("match_id", "innings").agg(
            _by(F.collect_list(F.struct(
                "over", F.transform("_balls", lambda x: x["b"].dropFields("seq"))
                .alias("deliveries"))), "over").alias("overs"),
            F.array_distinct(F.flatten(F.collect_list("_people"))).alias("_people"),
            F.array_distinct(F.flatten(F.collect_list("_outs"))).alias("_outs"),
            *[F.first(k).alias(k) for k in ("team", "target", "fmt", "gender", "format_key",
                                            "date", "year", "venue", "city", "venue_key",
                                            "country", "team1", "team2")],
        )
        inning = F.struct(
            "team", F.struct(c("target").cast("int").alias("runs"),
                             F.lit(None).cast("double").alias("overs")).alias("target"), "overs")
        inning = inning.withField("target", F.when(c("target").isNotNull(), inning["target"]))
        docs = innings.groupBy("match_id").agg(
            F.transform(_by(F.collect_list(F.struct("innings", inning.alias("i"))), "innings"),
                        lambda x: x["i"]).alias("_innings"),
            F.array_distinct(F.concat(F.flatten(F.collect_list("_people")),
                                      F.flatten(F.collect_list("_outs")))).alias("_people"),
            *[F.first(k).alias(k) for k in ("fmt", "gender", "format_key", "date", "year",
                                            "venue", "city", "venue_key", "country", "team1",
                                            "team2")],
        )
        none = lambda kind: F.lit(None).cast(kind)
        return docs.select(
            "match_id", "fmt", "gender", "format_key", "venue_key", "country",
            F.struct(
                F.array("date").alias("dates"), "gender", c("year").alias("season"),
                "venue", "city", F.array("team1", "team2").alias("teams"),
                F.struct(F.map_from_entries(F.col("_people")).alias("people")).alias("registry"),
                F.lit(6).alias("balls_per_over"),
            ).alias("info"),
            F.transform("_innings", lambda i: F.struct(
                i["team"].alias("team"), F.lit(False).alias("super_over"),
                F.lit(False).alias("declared"), i["target"].alias("target"),
                none("struct<pre:int,post:int>").alias("penalty_runs"),
                i["overs"].alias("overs"))).alias("innings"),
        )
