"""Queries over per-person statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from overstats.catalog.base import n_if, query, ratio, sql, total
from overstats.functions import flags, rates
from overstats.operators import players, ranking, state
from overstats.session import materialise

BAT = "balls, runs, outs, fours, sixes, dots, singles, scoring_balls"
BOWL = "balls, runs, wickets, dots, fours, sixes, wides, noballs"
BAT_RATES = f"""{ratio('runs', 'outs')} AS average, {ratio('runs', 'balls', 100)} AS strike_rate,
 {ratio('balls', 'outs')} AS balls_per_dismissal, {ratio('dots', 'balls', 100)} AS dot_pct,
 {ratio('fours + sixes', 'balls', 100)} AS boundary_pct, {ratio('fours * 4 + sixes * 6', 'runs', 100)} AS boundary_runs_pct"""
BOWL_RATES = f"""balls / CAST(6 AS DOUBLE) AS overs, {ratio('runs', 'balls', 6)} AS economy, {ratio('runs', 'wickets')} AS average,
 {ratio('balls', 'wickets')} AS strike_rate, {ratio('dots', 'balls', 100)} AS dot_pct,
 {ratio('fours + sixes', 'balls', 100)} AS boundary_pct"""


def bat_splits(t, mixed=False, only=None):
    return players.batting_splits(t.hold(mixed, only is None or bool({"position", "entry"} & set(only))), t.people, only)


def bowl_splits(t, mixed=False, only=None):
    return players.bowling_splits(t.hold(mixed), t.people, only)


def bat_innings(t, mixed=False):
    return state.batting_innings(t.mixed if mixed else t.deliveries)


def bowl_innings(t, mixed=False):
    return state.bowling_innings(t.mixed if mixed else t.deliveries)


def bat_overall(t, mixed=False):
    rows = t.hold(mixed)
    return players.batting_overall(bat_innings(t, mixed), players.batting_totals(rows))


def bowl_overall(t, mixed=False):
    rows = t.hold(mixed)
    return players.bowling_overall(bowl_innings(t, mixed), players.bowling_totals(rows))


@query(sql(f"""SELECT person_id, format_key, subject AS phase, {BAT}, {BAT_RATES}
FROM bs WHERE dimension = 'phase' AND balls >= 60""", "bs"))
def batting_by_phase(t):
    """Batting by phase above the display gate, with every rate."""
    c = F.col
    counts = players.batting_counts()
    return t.deliveries.groupBy(c("batter_id").alias("person_id"), "format_key", "phase").agg(
        *[v.alias(k) for k, v in counts.items()]
    ).where(c("balls") >= 60).withColumns(rates.batting_rates())


@query(sql(f"SELECT person_id, format_key, dimension, subject, {BAT} FROM bs", "bs"))
def batting_splits(t):
    return bat_splits(t)


@query(sql(f"SELECT person_id, format_key, dimension, subject, {BAT} FROM bsx", "bs", mixed=True))
def batting_splits_by_format(t):
    return bat_splits(t, mixed=True)


@query(sql(f"SELECT person_id, format_key, dimension, subject, {BOWL} FROM bws", "bws"))
def bowling_splits(t):
    return bowl_splits(t)


@query(sql(f"""SELECT person_id, format_key, dimension, subject, {BOWL}, {BOWL_RATES}
FROM bws WHERE balls >= 90 AND dimension <> 'all'""", "bws"))
def bowling_rates(t):
    return bowl_splits(t).where("balls >= 90 AND dimension <> 'all'").withColumns(rates.bowling_rates())


@query(sql(f"SELECT person_id, format_key, innings, {BAT}, {BAT_RATES} FROM box", "bo", mixed=True))
def batting_overall(t):
    return bat_overall(t, mixed=True).withColumns(rates.batting_rates())


@query(sql(f"SELECT person_id, format_key, innings, {BOWL} FROM bwox", "bwo", mixed=True))
def bowling_overall(t):
    return bowl_overall(t, mixed=True)


@query(sql("SELECT person_id, format_key, CAST(position AS VARCHAR) AS subject, COUNT(*) AS innings FROM bi GROUP BY 1, 2, 3", "bi"))
def position_innings(t):
    return players.position_innings(bat_innings(t))


@query(sql("""SELECT person_id, format_key, COUNT(*) AS matches, LIST_SORT(LIST(DISTINCT team)) AS teams
FROM nmx GROUP BY 1, 2""", "nm", mixed=True))
def appearances(t):
    return players.appearances(players.squads_from_deliveries(t.mixed))


def _named(rows):
    """Names change with the year, as players' display names do."""
    return rows.withColumn("name", F.concat(F.lit("Player "), F.substring("person_id", 2, 2),
                                            F.when(F.col("match_id") % 4 == 0, " Jr").otherwise("")))


NAMED = """SELECT person_id, format_key, date, match_id, 'Player ' || SUBSTR(person_id, 2, 2) ||
 CASE WHEN match_id % 4 = 0 THEN ' Jr' ELSE '' END AS name FROM nmx"""


@query(sql("""SELECT person_id, format_key, name, date FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY person_id, format_key
 ORDER BY date DESC, match_id DESC, name DESC) AS rn FROM named) WHERE rn = 1""", "nm", mixed=True, extra={"named": NAMED}))
def latest_names(t):
    return players.latest_names(_named(players.squads_from_deliveries(t.mixed)))


@query(sql("""SELECT person_id, name FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY date DESC, name DESC) AS rn
 FROM (SELECT person_id, name, date, ROW_NUMBER() OVER (PARTITION BY person_id, format_key
  ORDER BY date DESC, match_id DESC, name DESC) AS r FROM named) WHERE r = 1) WHERE rn = 1""", "nm", mixed=True, extra={"named": NAMED}))
def display_names(t):
    return players.display_names(
        players.latest_names(_named(players.squads_from_deliveries(t.mixed))))


@query(sql("""SELECT person_id, format_key, discipline, kind, subject, COUNT(*) AS n FROM (
 SELECT person_id, format_key, 'batting' AS discipline, 'how' AS kind, dismissal AS subject FROM bix WHERE out AND dismissal <> ''
 UNION ALL SELECT batter_id, format_key, 'batting', 'by_type', bowling_type FROM dx WHERE striker_out_kind IS NOT NULL AND bowling_type <> ''
 UNION ALL SELECT bowler_id, format_key, 'bowling', 'wicket_kind', credited_kind FROM dx WHERE credited_kind IS NOT NULL)
GROUP BY ALL""", "bi", mixed=True))
def dismissal_counts(t):
    t.hold(mixed=True)
    return players.dismissal_counts(bat_innings(t, True), t.mixed, t.people)


@query(sql(f"""SELECT person_id, format_key, {n_if('runs >= 50 AND runs < 100')} AS fifties, {n_if('runs >= 100')} AS hundreds,
 {n_if('runs >= 150')} AS one_fifties, {n_if('runs >= 200')} AS double_hundreds, {n_if('NOT out')} AS not_outs,
 MAX(runs) AS highest, ARG_MAX(NOT out, runs * 2 + CASE WHEN out THEN 0 ELSE 1 END) AS highest_not_out
FROM bi GROUP BY 1, 2""", "bi"))
def batting_milestones(t):
    return players.batting_milestones(bat_innings(t))


@query(sql(f"""SELECT person_id, format_key, CASE WHEN MAX(wickets) > 0 THEN MAX(wickets) END AS best_wickets,
 CASE WHEN MAX(wickets) > 0 THEN ARG_MAX(runs, wickets * 10000 - runs) END AS best_runs,
 {n_if('wickets = 4')} AS four_wickets, {n_if('wickets >= 5')} AS five_wickets, {total('maidens')} AS maidens
FROM wi GROUP BY 1, 2""", "wi"))
def bowling_milestones(t):
    return players.bowling_milestones(bowl_innings(t))


@query(sql(f"""SELECT person_id, MIN(date) AS debut, MAX(date) AS last_played, {total('balls')} AS sample_balls,
 LIST_SORT(LIST(DISTINCT team)) AS teams FROM (SELECT person_id, date, team, balls FROM bix
 UNION ALL SELECT person_id, date, team, balls FROM wix) GROUP BY 1""", "bi", "wi", mixed=True))
def career_spans(t):
    t.hold(mixed=True)
    return players.career_spans(bat_innings(t, True), bowl_innings(t, True))


@query(sql("""SELECT person_id, format_key, COALESCE(b.balls, 0) AS faced, COALESCE(w.balls, 0) AS bowled, COALESCE(w.wickets, 0) AS wickets,
 COALESCE(b.balls, 0) >= 60 AS has_batting, (COALESCE(w.balls, 0) >= 240 OR COALESCE(w.wickets, 0) >= 5) AS has_bowling
FROM box b FULL JOIN bwox w USING (person_id, format_key)
WHERE COALESCE(b.balls, 0) >= 60 OR COALESCE(w.balls, 0) >= 240 OR COALESCE(w.wickets, 0) >= 5""", "bo", "bwo", mixed=True))
def export_gates(t):
    return players.export_gates(bat_overall(t, True), bowl_overall(t, True))


@query(sql("""SELECT person_id, gender, conflict FROM (SELECT person_id, gender, COUNT(*) OVER (PARTITION BY person_id) > 1 AS conflict,
 ROW_NUMBER() OVER (PARTITION BY person_id ORDER BY balls DESC, gender) AS rn
 FROM (SELECT person_id, CASE WHEN format_key LIKE '%-w' THEN 'female' ELSE 'male' END AS gender, SUM(balls) AS balls
  FROM (SELECT person_id, format_key, balls FROM box UNION ALL SELECT person_id, format_key, balls FROM bwox) GROUP BY 1, 2)) WHERE rn = 1""",
           "bo", "bwo", mixed=True))
def resolve_genders(t):
    from overstats.operators.teams import gender_of_key
    cols = ("person_id", "format_key", "balls")
    balls = bat_overall(t, True).select(*cols).union(bowl_overall(t, True).select(*cols))
    return players.resolve_genders(balls.withColumn("gender", gender_of_key(F.col("format_key"))))


@query(sql(f"""SELECT person_id, format_key, subject, balls, runs, outs, rank FROM (SELECT *, ROW_NUMBER() OVER (
 PARTITION BY person_id, format_key ORDER BY balls DESC, subject) AS rank FROM bs WHERE dimension = 'vs_bowler' AND balls >= 20)
WHERE rank <= 40""", "bs"))
def head_to_heads(t):
    """The most-contested bowlers of each batter."""
    return players.head_to_heads(bat_splits(t), "vs_bowler", 20).select(
        "person_id", "format_key", "subject", "balls", "runs", "outs", "rank")


@query(sql("""SELECT person_id, format_key, year, b.runs, b.balls, b.outs, b.fours, b.sixes,
 COALESCE(bi_n, CASE WHEN b.balls IS NOT NULL THEN 0 END) AS bat_innings, w.bowl_balls, w.runs_conceded, w.wickets,
 COALESCE(wi_n, CASE WHEN w.bowl_balls IS NOT NULL THEN 0 END) AS bowl_innings
FROM (SELECT person_id, format_key, subject AS year, runs, balls, outs, fours, sixes FROM bsx WHERE dimension = 'year') b
FULL JOIN (SELECT person_id, format_key, subject AS year, balls AS bowl_balls, runs AS runs_conceded, wickets FROM bwsx WHERE dimension = 'year') w
 USING (person_id, format_key, year)
FULL JOIN (SELECT person_id, format_key, SUBSTR(date, 1, 4) AS year, COUNT(*) AS bi_n FROM bix GROUP BY 1, 2, 3) bn USING (person_id, format_key, year)
FULL JOIN (SELECT person_id, format_key, SUBSTR(date, 1, 4) AS year, COUNT(*) AS wi_n FROM wix GROUP BY 1, 2, 3) wn USING (person_id, format_key, year)""",
           "bo", "bwo", mixed=True))
def yearly(t):
    t.hold(mixed=True)
    return players.yearly(bat_splits(t, True, ("year",)), bowl_splits(t, True, ("year",)), bat_innings(t, True),
                          bowl_innings(t, True))


#: What careers are made of; the rest of an innings is neither worked out nor written.
INNINGS_BATTED = (*players.KEYS, "runs", "out", "outs_other_end")
INNINGS_BOWLED = (*players.KEYS, "runs", "wickets", "maidens")


def batted(t, mixed=False):
    """Innings of batters as careers need them, written once for all that read them."""
    if ("batted", mixed) not in t.written:
        t.hold(mixed)
        t.written["batted", mixed] = materialise(bat_innings(t, mixed).select(*INNINGS_BATTED), "batting-innings")
    return t.written["batted", mixed]


def careers_table(t, mixed=True):
    rows = t.hold(mixed)
    bi = batted(t, mixed)
    wi = materialise(bowl_innings(t, mixed).select(*INNINGS_BOWLED), "bowling-innings")
    return players.careers(
        players.squads_from_deliveries(rows),
        players.batting_overall(bi, players.batting_totals(rows)), players.batting_milestones(bi),
        players.bowling_overall(wi, players.bowling_totals(rows)), players.bowling_milestones(wi))


CAREER = ("person_id", "format_key", "matches", "bat_innings", "runs", "balls", "outs", "fours",
          "sixes", "dots", "highest", "hundreds", "fifties", "bowl_innings", "bowl_balls",
          "runs_conceded", "wickets", "maidens", "five_wickets", "bat_avg", "bat_sr", "bowl_avg",
          "bowl_econ", "bowl_sr")


@query(sql(f"SELECT {', '.join(CAREER)} FROM carx", "car", mixed=True))
def careers(t):
    return careers_table(t).select(*CAREER)


TOTALS = f"""SELECT person_id, LIST_SORT(LIST(format_key)) AS format_keys,
 CASE WHEN COUNT(*) = COUNT(matches) THEN CAST(SUM(matches) AS BIGINT) END AS matches, CAST(SUM(bat_innings) AS BIGINT) AS bat_innings,
 CAST(SUM(runs) AS BIGINT) AS runs, CAST(SUM(balls) AS BIGINT) AS balls, CAST(SUM(outs) AS BIGINT) AS outs,
 CAST(SUM(hundreds) AS BIGINT) AS hundreds, CAST(SUM(fifties) AS BIGINT) AS fifties, CAST(SUM(wickets) AS BIGINT) AS wickets,
 CAST(SUM(bowl_balls) AS BIGINT) AS bowl_balls, CAST(SUM(runs_conceded) AS BIGINT) AS runs_conceded, MAX(highest) AS highest
FROM carx GROUP BY person_id"""
TOTAL_RATES = f"""{ratio('runs', 'outs')} AS bat_avg, {ratio('runs', 'balls', 100)} AS bat_sr,
 {ratio('runs_conceded', 'wickets')} AS bowl_avg, {ratio('runs_conceded', 'bowl_balls', 6)} AS econ"""


@query(sql(f"SELECT *, {TOTAL_RATES} FROM tot", "car", mixed=True, extra={"tot": TOTALS}))
def career_totals(t):
    return players.career_totals(careers_table(t))


@query(sql(f"""SELECT person_id, format_key, COUNT(*) AS innings, {total('runs')} AS runs, {n_if('out')} AS outs, {total('balls')} AS balls,
 MIN(date) AS first_date, MAX(date) AS last_date, {ratio(total('runs'), n_if('out'))} AS average,
 {ratio(total('runs'), total('balls'), 100)} AS strike_rate
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY person_id, format_key ORDER BY date DESC, match_id DESC, innings DESC) AS rn FROM bi)
WHERE rn <= 10 GROUP BY 1, 2""", "bi"))
def batting_form(t):
    return players.batting_form(bat_innings(t))


@query(sql(f"""SELECT person_id, format_key, COUNT(*) AS innings, {total('wickets')} AS wickets, {total('runs')} AS runs_conceded,
 {total('balls')} AS balls, MIN(date) AS first_date, MAX(date) AS last_date
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY person_id, format_key ORDER BY date DESC, match_id DESC, innings DESC) AS rn FROM wi)
WHERE rn <= 10 GROUP BY 1, 2""", "wi"))
def bowling_form(t):
    return players.bowling_form(bowl_innings(t))


@query(sql("""SELECT person_id, format_key, match_id, innings, date, runs, balls, rank, venue FROM (SELECT bi.*, ROW_NUMBER() OVER (
 PARTITION BY person_id, format_key ORDER BY date DESC, match_id DESC, innings DESC) AS rank FROM bi) WHERE rank <= 25""", "bi"))
def recent_innings(t):
    """The last 25 innings with the venue taken from the match row."""
    venues = t.deliveries.groupBy("match_id").agg(F.min("venue").alias("venue"))
    rows = players.recent(bat_innings(t).drop("venue"), 25)
    return rows.join(venues, "match_id", "left").select(
        "person_id", "format_key", "match_id", "innings", "date", "runs", "balls", "rank", "venue")


@query(sql("""SELECT format_key, COUNT(DISTINCT bowler_id) AS bowlers FROM dx WHERE bowling_type = '' GROUP BY 1""", "d", mixed=True))
def bowlers_without_style(t):
    return players.bowlers_without_style(t.mixed, t.people)


@query(sql(f"""SELECT bowler_id, batting_hand, bowling_type, bowling_family, {n_if('is_legal')} AS balls, {total('conceded')} AS runs
FROM d GROUP BY 1, 2, 3, 4""", "d"))
def balls_by_style(t):
    """Deliveries joined to the bowler's style and the batter's hand."""
    c = F.col
    return players.with_people(t.deliveries, t.people).groupBy(
        "bowler_id", "batting_hand", "bowling_type", "bowling_family"
    ).agg(flags.count_if(c("is_legal")).alias("balls"), flags.total(c("conceded")).alias("runs"))


@query("""WITH e AS (SELECT event_type, CAST(user_id AS BIGINT) AS user_id, CAST(COUNT(*) AS BIGINT) AS n FROM events GROUP BY 1, 2),
r AS (SELECT *, RANK() OVER (PARTITION BY event_type ORDER BY n) AS rk, COUNT(*) OVER (PARTITION BY event_type, n) AS peers,
 COUNT(*) OVER (PARTITION BY event_type) AS total FROM e)
SELECT event_type, user_id, n, rk - 1 AS below, peers AS ties, total AS pool,
 CAST(100 AS DOUBLE) * ((rk - 1 + rk - 1 + peers) / CAST(2 AS DOUBLE)) / total AS percentile FROM r""")
def event_percentiles(t):
    """The cohort ranking on a second domain: users by events of a kind."""
    c = F.col
    counts = t.table("events").groupBy("event_type", "user_id").agg(
        F.count(F.lit(1)).alias("value")).withColumn("pool", F.lit(True))
    ranked = ranking.ranks_against_pool(counts, ("event_type",), "value", "pool")
    return ranked.select(
        "event_type", "user_id", c("value").alias("n"), "below", "ties", c("n").alias("pool"),
        ranking.mid_rank(c("below"), c("ties"), c("n"), F.lit(True)).alias("percentile"))


@query("""SELECT event_type, COUNT(*) AS n, QUANTILE_CONT(value, 0.1) AS p10, QUANTILE_CONT(value, 0.5) AS p50,
 QUANTILE_CONT(value, 0.9) AS p90 FROM events GROUP BY 1""")
def event_quantiles(t):
    return ranking.quantiles(t.table("events").where("value IS NOT NULL"), ("event_type",), "value",
                             (0.1, 0.5, 0.9))
