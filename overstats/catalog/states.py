"""Queries over ordered match state."""

from __future__ import annotations

from pyspark.sql import functions as F

from overstats.catalog.base import n_if, query, ratio, sql, total
from overstats.functions import rates, text
from overstats.operators import state
from overstats.sources import documents as docs

BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
KEYS = ("match_id", "innings", "seq")
BALL = f"""over_no AS "over", ball_in_over, batter_id, non_striker_id, bowler_id, runs_batter, runs_extras,
 runs_total, is_legal, is_faced, is_dot, is_bowler_dot, team_wickets, credited_kind, striker_out_kind, conceded, phase"""
BALL_COLS = ("over", "ball_in_over", "batter_id", "non_striker_id", "bowler_id", "runs_batter",
             "runs_extras", "runs_total", "is_legal", "is_faced", "is_dot", "is_bowler_dot",
             "team_wickets", "credited_kind", "striker_out_kind", "conceded", "phase")


@query(sql(f"SELECT match_id, innings, seq, {BALL} FROM d", "d"))
def delivery_flags(t):
    return t.deliveries.select(*KEYS, *BALL_COLS)


@query(sql(f"SELECT match_id, innings, seq, {BALL} FROM dx", "d", mixed=True))
def flatten_documents(t):
    """Matches folded into nested documents and flattened again."""
    return docs.flatten(t.documents(mixed=True)).select(*KEYS, *BALL_COLS)


@query(sql(f"""SELECT match_id, innings, seq,
 CAST(SUM(CASE WHEN is_legal THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, innings ORDER BY seq {UPTO}) AS BIGINT) AS ball_no,
 CAST(COALESCE(SUM(runs_total) OVER (PARTITION BY match_id, innings ORDER BY seq {BEFORE}), 0) AS BIGINT) AS score_before,
 CAST(COALESCE(SUM(team_wickets) OVER (PARTITION BY match_id, innings ORDER BY seq {BEFORE}), 0) AS BIGINT) AS wickets_before
FROM d""", "d"))
def running_state(t):
    return state.running_state(t.deliveries).select(
        *KEYS, "ball_no", "score_before", "wickets_before")


@query(sql("SELECT match_id, innings, person_id, MIN(position) AS position FROM app GROUP BY 1, 2, 3", "app"))
def arrival_positions(t):
    return state.appearances(t.deliveries).groupBy("match_id", "innings", "person_id").agg(
        F.min("position").alias("position"))


@query(sql(f"""SELECT match_id, innings, seq, batter_id, faced_before,
 CASE WHEN faced_before < 15 THEN 'new' WHEN faced_before < 40 THEN 'settling' ELSE 'set' END AS entry FROM (
 SELECT *, CAST(COALESCE(SUM(CASE WHEN is_faced THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, innings, batter_id
  ORDER BY seq {BEFORE}), 0) AS BIGINT) AS faced_before FROM d)""", "d"))
def balls_faced_before(t):
    from overstats.functions.flags import entry_phase
    return state.faced_before(t.deliveries).select(
        *KEYS, "batter_id", "faced_before", entry_phase(F.col("faced_before")).alias("entry"))


@query(sql(f"""SELECT match_id, innings, seq, target,
 120 - CAST(SUM(CASE WHEN is_legal THEN 1 ELSE 0 END) OVER w AS BIGINT) AS balls_left,
 CAST(SUM(team_wickets) OVER w AS BIGINT) AS wickets, CAST(SUM(runs_total) OVER w AS BIGINT) AS runs
FROM d WINDOW w AS (PARTITION BY match_id, innings ORDER BY seq {UPTO})""", "d"))
def replay_states(t):
    return state.replay_states(t.deliveries, F.lit(120)).drop("format_key")


TIMELINE = f"""
 SELECT d.*, CAST(over_no AS VARCHAR) || '.' || CAST(1 + COALESCE(SUM(CASE WHEN is_legal THEN 1 ELSE 0 END) OVER (
   PARTITION BY match_id, innings, over_no ORDER BY seq {BEFORE}), 0) AS VARCHAR) AS label,
  CAST(SUM(CASE WHEN is_legal THEN 1 ELSE 0 END) OVER w AS BIGINT) AS legal_balls,
  CAST(SUM(runs_total) OVER w AS BIGINT) AS score, CAST(SUM(team_wickets) OVER w AS BIGINT) AS wickets_down,
  ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY innings, seq) AS cursor_no
 FROM d WINDOW w AS (PARTITION BY match_id, innings ORDER BY seq {UPTO})"""
TL = {"tl": TIMELINE}


@query(sql("SELECT match_id, innings, seq, label, legal_balls, score, wickets_down FROM tl", "d", extra=TL))
def timeline(t):
    return state.timeline(t.deliveries).select(*KEYS, "label", "legal_balls", "score", "wickets_down")


@query(sql(f"""SELECT match_id, innings, seq, cursor_no AS "cursor", batting_team, score AS runs, wickets_down AS wickets,
 legal_balls, CASE WHEN legal_balls % 6 = 0 THEN CAST(legal_balls // 6 AS VARCHAR)
   ELSE CAST(legal_balls // 6 AS VARCHAR) || '.' || CAST(legal_balls % 6 AS VARCHAR) END AS overs,
 {ratio('score', 'legal_balls', 6)} AS run_rate, target,
 CASE WHEN target IS NOT NULL THEN GREATEST(0, target - score) END AS need,
 GREATEST(0, 120 - legal_balls) AS balls_left,
 CASE WHEN 120 - legal_balls > 0 AND target - score > 0 THEN CAST(6 AS DOUBLE) * (target - score) / (120 - legal_balls) END AS required_rate,
 CASE WHEN COALESCE(n_over, over_no) < 6 THEN 'powerplay' WHEN COALESCE(n_over, over_no) < 15 THEN 'middle' ELSE 'death' END AS phase,
 CASE WHEN n_over IS NOT NULL THEN n_bat WHEN batter_id IN (COALESCE(out1, ''), COALESCE(out2, '')) THEN NULL ELSE batter_id END AS striker_id,
 CASE WHEN n_over IS NOT NULL THEN n_non WHEN non_striker_id IN (COALESCE(out1, ''), COALESCE(out2, '')) THEN NULL ELSE non_striker_id END AS non_striker_id,
 COALESCE(n_bowl, bowler_id) AS bowler_id, n_over IS NULL AS innings_complete, n_cursor IS NULL AS match_complete
FROM (SELECT *, LEAD(over_no) OVER i AS n_over, LEAD(batter_id) OVER i AS n_bat, LEAD(non_striker_id) OVER i AS n_non,
  LEAD(bowler_id) OVER i AS n_bowl, LEAD(cursor_no) OVER (PARTITION BY match_id ORDER BY cursor_no) AS n_cursor
 FROM tl WINDOW i AS (PARTITION BY match_id, innings ORDER BY seq))""", "d", extra=TL))
def scoreboard(t):
    return state.scoreboard(t.deliveries, F.lit(120))


CARD = "cursor_no <= 40 + match_id % 100"


def _cursor():
    return 40 + F.col("match_id") % 100


def _card_sql() -> str:
    """The innings-log blocks over a prefix of each match instead of all of it."""
    full = sql("SELECT 1", "bi")
    head, tail = full.split(",\nw AS (", 1)
    head = head.replace("\nd AS (", "\nd_all AS (", 1)
    cut = f"""d AS (SELECT * EXCLUDE (cursor_no) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY innings, seq) AS cursor_no
 FROM d_all) WHERE {CARD})"""
    up = """up AS (SELECT match_id, innings, UNNEST(list_distinct([batter_id, non_striker_id])) AS person_id FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY innings, seq) AS cursor_no FROM d_all)
 WHERE cursor_no = 41 + match_id % 100)"""
    tail = tail.rsplit("\n", 1)[0]
    body = """SELECT COALESCE(c.match_id, u.match_id) AS match_id, COALESCE(c.innings, u.innings) AS innings,
 COALESCE(c.person_id, u.person_id) AS person_id, position, COALESCE(runs, 0) AS runs, COALESCE(balls, 0) AS balls,
 COALESCE(fours, 0) AS fours, COALESCE(sixes, 0) AS sixes, COALESCE(out, FALSE) AS out,
 (u.person_id IS NOT NULL AND NOT COALESCE(out, FALSE) AND COALESCE(dismissal, '') = '') AS at_crease,
 CASE WHEN COALESCE(dismissal, '') = '' THEN NULL WHEN dismissed_by_id = '' THEN dismissal
  WHEN dismissal = 'bowled' THEN 'b Player ' || SUBSTR(dismissed_by_id, 2)
  ELSE dismissal || ' b Player ' || SUBSTR(dismissed_by_id, 2) END AS dismissal_label
FROM bi c FULL JOIN (SELECT up.* FROM up SEMI JOIN bi ON up.match_id = bi.match_id AND up.innings = bi.innings) u
 ON c.match_id = u.match_id AND c.innings = u.innings AND c.person_id = u.person_id"""
    return f"{head},\n{cut},\nw AS ({tail},\n{up}\n{body}"


@query(_card_sql())
def batting_card(t):
    return state.batting_card(t.deliveries, _cursor())


@query(sql(f"""SELECT match_id, innings, person_id, CASE WHEN balls % 6 = 0 THEN CAST(balls // 6 AS VARCHAR)
  ELSE CAST(balls // 6 AS VARCHAR) || '.' || CAST(balls % 6 AS VARCHAR) END AS overs, balls, maidens, runs, wickets, wides, noballs
FROM (SELECT match_id, innings, bowler_id AS person_id, {total('balls')} AS balls, {total('runs')} AS runs,
  {total('wickets')} AS wickets, {total('wides')} AS wides, {total('noballs')} AS noballs, {n_if('runs = 0 AND balls >= 6')} AS maidens
 FROM (SELECT match_id, innings, bowler_id, over_no, {n_if('is_legal')} AS balls, {total('conceded')} AS runs,
   {n_if('credited_kind IS NOT NULL')} AS wickets, {n_if('wides > 0')} AS wides, {n_if('noballs > 0')} AS noballs
  FROM tl WHERE {CARD} GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)""", "d", extra=TL))
def bowling_card(t):
    return state.bowling_card(t.deliveries, _cursor())


@query(sql(f"""SELECT match_id, innings, {total('wides')} AS wides, {total('noballs')} AS noballs, {total('byes')} AS byes,
 {total('legbyes')} AS legbyes, CAST(0 AS BIGINT) AS penalty, {total('runs_extras')} AS total
FROM tl WHERE {CARD} GROUP BY 1, 2""", "d", extra=TL))
def extras_card(t):
    return state.extras_card(t.deliveries, _cursor())


STANDS = {"p": f"""
 SELECT *, SUM(CASE WHEN prev_low = low_id AND prev_high = high_id AND NOT prev_fell THEN 0 ELSE 1 END)
   OVER (PARTITION BY match_id, innings ORDER BY seq {UPTO}) AS stand FROM (
  SELECT z.*, LAG(low_id) OVER i AS prev_low, LAG(high_id) OVER i AS prev_high, LAG(fell) OVER i AS prev_fell,
   COALESCE(SUM(team_wickets) OVER (PARTITION BY match_id, innings ORDER BY seq {BEFORE}), 0) AS before FROM (
   SELECT d.*, LEAST(batter_id, non_striker_id) AS low_id, GREATEST(batter_id, non_striker_id) AS high_id,
    kind1 IS NOT NULL AS fell FROM d) z WINDOW i AS (PARTITION BY match_id, innings ORDER BY seq))"""}


@query(sql(f"""SELECT match_id, innings, CAST(MIN(before) + 1 AS BIGINT) AS wicket, ANY_VALUE(low_id) AS low_id,
 ANY_VALUE(high_id) AS high_id, {total('runs_total')} AS runs, {n_if('is_legal')} AS balls, NOT BOOL_OR(fell) AS unbroken,
 MIN(seq) AS first_seq, CAST(0 AS BIGINT) AS extra_no FROM p GROUP BY match_id, innings, stand
UNION ALL
SELECT match_id, innings, CAST(before + 2 AS BIGINT), LEAST(alive, out2), GREATEST(alive, out2), 0, 0, FALSE, seq, 1
FROM (SELECT *, CASE WHEN out1 = batter_id AND out2 <> non_striker_id THEN non_striker_id END AS alive FROM p)
WHERE kind2 IS NOT NULL AND alive IS NOT NULL AND out2 NOT IN (batter_id, non_striker_id)""", "d", extra=STANDS))
def partnerships(t):
    return state.partnerships(t.deliveries)


@query(sql("""SELECT match_id, innings, CAST(wickets_down - team_wickets + k AS BIGINT) AS wicket, score AS runs, person_id, kind, label
FROM (SELECT tl.*, 1 AS k, out1 AS person_id, kind1 AS kind FROM tl WHERE kind1 NOT IN ('retired hurt', 'retired not out')
 UNION ALL SELECT tl.*, 2, out2, kind2 FROM tl WHERE kind2 IS NOT NULL)""", "d", extra=TL))
def fall_of_wickets(t):
    return state.fall_of_wickets(t.deliveries)


@query(sql("""SELECT match_id, innings, legal_balls, runs, wickets,
 wickets - COALESCE(LAG(wickets) OVER (PARTITION BY match_id, innings ORDER BY legal_balls), 0) AS wickets_in_over
FROM (SELECT match_id, innings, legal_balls, ARG_MAX(score, seq) AS runs, ARG_MAX(wickets_down, seq) AS wickets
 FROM (SELECT *, LEAD(seq) OVER (PARTITION BY match_id, innings ORDER BY seq) IS NULL AS is_last FROM tl)
 WHERE (is_legal AND legal_balls % 6 = 0) OR is_last GROUP BY 1, 2, 3)""", "d", extra=TL))
def worm(t):
    return state.worm(t.deliveries)


@query(sql("""SELECT match_id, innings, over_no AS "over", start_cursor, end_cursor,
 LAG(start_cursor) OVER w AS previous_start, COALESCE(LEAD(start_cursor) OVER w, end_cursor) AS next_start
FROM (SELECT match_id, innings, over_no, MIN(cursor_no) - 1 AS start_cursor, MAX(cursor_no) AS end_cursor FROM tl GROUP BY 1, 2, 3)
WINDOW w AS (PARTITION BY match_id ORDER BY start_cursor)""", "d", extra=TL))
def over_boundaries(t):
    return state.over_boundaries(t.deliveries)


@query(sql(f"""SELECT match_id, innings, person_id, position, runs, balls, fours, sixes, out, dismissal, dismissed_by_id,
 outs_other_end, team, opposition, chasing, date FROM bix""", "bi", mixed=True))
def batting_innings(t):
    return state.batting_innings(t.mixed).select(
        "match_id", "innings", "person_id", "position", "runs", "balls", "fours", "sixes", "out",
        "dismissal", "dismissed_by_id", "outs_other_end", "team", "opposition", "chasing", "date")


@query(sql("""SELECT match_id, innings, person_id, team, opposition, date, balls, runs, wickets, maidens, wide_balls,
 noball_balls FROM wix""", "wi", mixed=True))
def bowling_innings(t):
    return state.bowling_innings(t.mixed).select(
        "match_id", "innings", "person_id", "team", "opposition", "date", "balls", "runs",
        "wickets", "maidens", "wide_balls", "noball_balls")


@query(sql(f"""SELECT match_id, innings, seq, legal_balls,
 CASE WHEN rn >= 5 THEN CAST(SUM(runs_total) OVER (PARTITION BY match_id, innings ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT)
   / CAST(5 AS DOUBLE) END AS rolling
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY match_id, innings ORDER BY seq) AS rn FROM tl)""", "d", extra=TL))
def rolling_runs(t):
    from overstats.operators.ranking import rolling_mean
    return rolling_mean(state.timeline(t.deliveries), ("match_id", "innings"), (F.asc("seq"),),
                        "runs_total", 5).select(*KEYS, "legal_balls", "rolling")


@query(sql(f"""SELECT match_id, innings, seq, u, w, r FROM (SELECT match_id, innings, seq, is_legal,
  120 - CAST(COALESCE(SUM(CASE WHEN is_legal THEN 1 ELSE 0 END) OVER i, 0) AS BIGINT) AS u,
  CAST(COALESCE(SUM(team_wickets) OVER i, 0) AS BIGINT) AS w, CAST(COALESCE(SUM(runs_total) OVER i, 0) AS BIGINT) AS r
 FROM d WINDOW i AS (PARTITION BY match_id, innings ORDER BY seq {BEFORE})) WHERE is_legal AND (120 - u) % 6 = 0""", "d"))
def every_sixth_state(t):
    from overstats.operators.winmodel import sampled
    rows = state.running_state(t.deliveries).where("is_legal").withColumn(
        "state_no", F.col("ball_no") - 1)
    return sampled(rows, 6).select(*KEYS, (120 - F.col("state_no")).alias("u"),
                                   F.col("wickets_before").alias("w"), F.col("score_before").alias("r"))


@query(sql("""SELECT match_id, innings, seq, label, tone, description FROM (SELECT *,
 CASE WHEN team_wickets > 0 THEN 'W' WHEN runs_extras > 0 THEN CAST(runs_total AS VARCHAR) ||
   CASE WHEN wides > 0 THEN 'wd' WHEN noballs > 0 THEN 'nb' WHEN byes > 0 THEN 'b' ELSE 'lb' END
  WHEN runs_batter = 0 THEN '•' ELSE CAST(runs_batter AS VARCHAR) END AS label,
 CASE WHEN team_wickets > 0 THEN 'wicket' WHEN runs_extras > 0 THEN 'extra' WHEN runs_batter = 0 THEN 'dot'
  WHEN runs_batter IN (4, 6) THEN 'boundary' ELSE 'run' END AS tone,
 CASE WHEN team_wickets > 0 THEN kinds || CASE WHEN runs_total = 0 THEN '' WHEN runs_total = 1 THEN ', 1 run' ELSE ', ' || CAST(runs_total AS VARCHAR) || ' runs' END
  WHEN runs_extras > 0 THEN CONCAT_WS(', ', CASE WHEN wides = 1 THEN '1 wide' WHEN wides > 1 THEN CAST(wides AS VARCHAR) || ' wides' END,
    CASE WHEN noballs = 1 THEN '1 no-ball' END, CASE WHEN byes = 1 THEN '1 bye' END, CASE WHEN legbyes = 2 THEN '2 leg byes' END,
    CASE WHEN runs_batter > 0 THEN CAST(runs_batter AS VARCHAR) || ' off the bat' END) || also
  WHEN runs_batter = 0 THEN 'dot ball' || also WHEN runs_batter = 4 THEN 'four' || also WHEN runs_batter = 6 THEN 'six' || also
  WHEN runs_batter = 1 THEN '1 run' || also ELSE CAST(runs_batter AS VARCHAR) || ' runs' || also END AS description
FROM (SELECT *, CASE WHEN kind2 IS NOT NULL THEN kind1 || ' and ' || kind2 ELSE COALESCE(kind1, '') END AS kinds,
  CASE WHEN kind1 IS NOT NULL THEN ', ' || kind1 ELSE '' END AS also FROM d))""", "d"))
def ball_labels(t):
    return t.deliveries.select(*KEYS, *[v.alias(k) for k, v in text.ball_labels().items()])


@query(sql(f"""SELECT match_id, innings, wides, noballs, byes, legbyes, wicket_entries, team_wickets, charged FROM (
 SELECT match_id, innings, {total('wides')} AS wides, {total('noballs')} AS noballs, {total('byes')} AS byes,
 {total('legbyes')} AS legbyes, {total('(CASE WHEN kind1 IS NULL THEN 0 ELSE 1 END) + (CASE WHEN kind2 IS NULL THEN 0 ELSE 1 END)')} AS wicket_entries,
 {total('team_wickets')} AS team_wickets, {total('runs_batter + wides + noballs')} AS charged FROM dx GROUP BY 1, 2)""", "d", mixed=True))
def extras_and_wickets(t):
    """Extras by kind, wicket entries and charged runs, read from documents."""
    rows = docs.flatten(t.documents(mixed=True))
    c = F.col
    return rows.groupBy("match_id", "innings").agg(
        *[F.sum(k).alias(k) for k in ("wides", "noballs", "byes", "legbyes")],
        F.sum(F.size("wickets")).alias("wicket_entries"),
        F.sum("team_wickets").alias("team_wickets"), F.sum(c("conceded")).alias("charged"))


@query(sql(f"""SELECT batting_team, phase, balls, runs, wickets, {ratio('runs', 'balls', 6)} AS runs_per_over,
 {ratio('balls', 'wickets')} AS balls_per_wicket, {ratio('dots', 'balls', 100)} AS dot_pct,
 {ratio('fours + sixes', 'balls', 100)} AS boundary_pct FROM (
 SELECT batting_team, phase, {n_if('is_legal')} AS balls, {total('runs_total')} AS runs, {total('team_wickets')} AS wickets,
 {n_if('is_bowler_dot')} AS dots, {n_if('runs_batter = 4')} AS fours, {n_if('runs_batter = 6')} AS sixes FROM d GROUP BY 1, 2)""", "d"))
def scoring_by_phase(t):
    from overstats.functions import flags
    c = F.col
    return t.deliveries.groupBy("batting_team", "phase").agg(
        flags.count_if(c("is_legal")).alias("balls"), flags.total(c("runs_total")).alias("runs"),
        flags.total(c("team_wickets")).alias("wickets"),
        flags.count_if(c("is_bowler_dot")).alias("dots"), flags.count_if(c("is_four")).alias("fours"),
        flags.count_if(c("is_six")).alias("sixes"),
    ).withColumns(rates.phase_rates()).drop("dots", "fours", "sixes")
