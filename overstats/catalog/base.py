"""Registry of queries and the shared SQL the oracles are built from."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overstats.sources.tables import APART, GROUNDS, TEAMS, TYPE_CODES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, so both engines report one integer type."""
    cols = [
        F.col(n).cast("bigint").alias(n)
        if t in ("int", "smallint", "tinyint") or t.startswith("decimal") else F.col(n)
        for n, t in df.dtypes
    ]
    return df.select(*cols)


def query(sql: str | None = None):
    """Register a function of :class:`Tables` under its own name, which no other query has."""

    def register(fn: Callable[[Tables], DataFrame]):
        if fn.__name__ in QUERIES:
            raise ValueError(f"two queries are named {fn.__name__}")

        @functools.wraps(fn)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return tidy(fn(Tables(spark, folder)))

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


# ---------------------------------------------------------------------------
# SQL building blocks
# ---------------------------------------------------------------------------
def pick(values, index: str) -> str:
    items = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{items}], CAST({index} + 1 AS INT))"


def ratio(top: str, bottom: str, scale: int = 1) -> str:
    return f"CASE WHEN {bottom} > 0 THEN CAST({scale} AS DOUBLE) * ({top}) / ({bottom}) END"


def total(expr: str) -> str:
    return f"CAST(COALESCE(SUM({expr}), 0) AS BIGINT)"


def n_if(test: str) -> str:
    return f"CAST(COUNT(CASE WHEN {test} THEN 1 END) AS BIGINT)"


def two(expr: str) -> str:
    return f"LPAD(CAST({expr} AS VARCHAR), 2, '0')"


PHASE = """CASE WHEN {f} = 'test' THEN CASE WHEN {o} < 20 THEN 'new_ball' WHEN {o} < 80 THEN 'old_ball' ELSE 'second_new' END
 WHEN {f} = 't20i' THEN CASE WHEN {o} < 6 THEN 'powerplay' WHEN {o} < 15 THEN 'middle' ELSE 'death' END
 ELSE CASE WHEN {o} < 10 THEN 'powerplay' WHEN {o} < 40 THEN 'middle' ELSE 'death' END END"""
HOME = """CASE WHEN {c} = '' THEN '' WHEN {t} = 'England' THEN CASE WHEN {c} IN ('England', 'Wales') THEN 'home' ELSE 'away' END
 WHEN {t} = {c} THEN 'home' ELSE 'away' END"""
NOT_OUT = "('retired hurt', 'retired not out')"
NOT_BOWLER = ("('run out', 'retired hurt', 'retired out', 'retired not out', 'obstructing the field',"
              " 'handled the ball', 'timed out')")


def _balls(mixed: bool) -> str:
    m = "CAST(FLOOR(l_orderkey / 64.0) AS BIGINT)"
    return f"""
SELECT {m} AS match_id, CAST(1 + CAST(FLOOR(l_orderkey / 32.0) AS BIGINT) % 2 AS BIGINT) AS innings,
  CAST(l_quantity AS INT) AS q, CAST(ROUND(l_discount * 100) AS INT) AS dd, CAST(ROUND(l_tax * 100) AS INT) AS tt,
  l_partkey % 60 AS s, (l_partkey + 7) % 60 AS o, l_suppkey % 40 AS b,
  ROW_NUMBER() OVER (PARTITION BY {m}, CAST(FLOOR(l_orderkey / 32.0) AS BIGINT) % 2
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
      CAST(l_quantity AS INT), CAST(ROUND(l_discount * 100) AS INT), CAST(ROUND(l_tax * 100) AS INT)) AS seq
FROM lineitem"""


def _header(mixed: bool) -> str:
    fmt = ("CASE WHEN match_id % 5 = 3 THEN 'odi' WHEN match_id % 5 = 4 THEN 'test' ELSE 't20i' END"
           if mixed else "'t20i'")
    sex = "CASE WHEN match_id % 7 = 0 THEN 'female' ELSE 'male' END" if mixed else "'male'"
    key = f"({fmt}) || CASE WHEN ({sex}) = 'female' THEN '-w' ELSE '-m' END"
    date = (f"CAST(2010 + match_id % 14 AS VARCHAR) || '-' || {two('1 + match_id % 12')}"
            f" || '-' || {two('1 + match_id % 28')}")
    return f"""{fmt} AS fmt, {sex} AS gender, {key} AS format_key, {date} AS date,
  CAST(2010 + match_id % 14 AS VARCHAR) AS year,
  {pick([g[0] for g in GROUNDS], 'match_id % 12')} AS venue,
  {pick([g[1] for g in GROUNDS], 'match_id % 12')} AS city,
  {pick([g[2] for g in GROUNDS], 'match_id % 12')} AS venue_key,
  {pick([g[3] for g in GROUNDS], 'match_id % 12')} AS country,
  {pick(TEAMS, 'match_id % 8')} AS team1, {pick(TEAMS, '(match_id + 3) % 8')} AS team2"""


def _deliveries(x: str, mixed: bool) -> str:
    return f"""
SELECT e.*, CASE WHEN innings = 2 AND fmt <> 'test' THEN
    CAST(SUM(CASE WHEN innings = 1 THEN runs_total END) OVER (PARTITION BY match_id) AS BIGINT) + 1 END AS target,
  ROW_NUMBER() OVER (PARTITION BY match_id, innings, over_no ORDER BY seq) AS ball_in_over,
  {PHASE.format(f='fmt', o='over_no')} AS phase,
  CAST(CASE WHEN kind1 IS NOT NULL AND kind1 NOT IN {NOT_OUT} THEN 1 ELSE 0 END
   + CASE WHEN kind2 IS NOT NULL AND kind2 NOT IN {NOT_OUT} THEN 1 ELSE 0 END AS BIGINT) AS team_wickets,
  CASE WHEN kind1 IS NOT NULL AND kind1 NOT IN {NOT_BOWLER} THEN kind1
       WHEN kind2 IS NOT NULL AND kind2 NOT IN {NOT_BOWLER} THEN kind2 END AS credited_kind,
  CASE WHEN out1 = batter_id AND kind1 NOT IN {NOT_OUT} THEN kind1
       WHEN out2 = batter_id AND kind2 NOT IN {NOT_OUT} THEN kind2 END AS striker_out_kind,
  runs_batter + wides + noballs AS conceded,
  (is_faced AND runs_batter = 0 AND runs_total = 0) AS is_dot,
  (is_legal AND runs_total = 0) AS is_bowler_dot,
  {pick(TYPE_CODES, 'b % 10')} AS bowling_type,
  CASE WHEN b % 10 < 6 THEN 'pace' WHEN b % 10 < 9 THEN 'spin' ELSE '' END AS bowling_family,
  CASE WHEN s % 3 = 0 THEN 'left' ELSE 'right' END AS batting_hand
FROM (
 SELECT c.*, runs_batter + wides + noballs + byes + legbyes AS runs_total,
  wides + noballs + byes + legbyes AS runs_extras,
  CAST(FLOOR(COALESCE(SUM(CASE WHEN is_legal THEN 1 ELSE 0 END) OVER (PARTITION BY match_id, innings ORDER BY seq
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 6) AS BIGINT) AS over_no,
  CASE WHEN innings = 1 THEN team1 ELSE team2 END AS batting_team,
  CASE WHEN innings = 1 THEN team2 ELSE team1 END AS bowling_team
 FROM (
  SELECT a.*, CAST(CASE WHEN q % 13 <> 0 AND q % 17 <> 0 AND runs_batter = 0 AND q % 11 = 0 THEN 1 ELSE 0 END AS BIGINT) AS byes,
    CAST(CASE WHEN q % 13 <> 0 AND q % 17 <> 0 AND runs_batter = 0 AND q % 21 = 0 THEN 2 ELSE 0 END AS BIGINT) AS legbyes,
    (q % 13 <> 0 AND q % 17 <> 0) AS is_legal, (q % 13 <> 0) AS is_faced
  FROM (
   SELECT r.*, {_header(mixed)},
    CAST(CASE WHEN q % 13 = 0 OR q % 10 < 4 THEN 0 WHEN q % 10 < 7 THEN 1 WHEN q % 10 = 7 THEN 2
         WHEN q % 10 = 8 THEN 4 ELSE 6 END AS BIGINT) AS runs_batter,
    CAST(CASE WHEN q % 13 = 0 THEN CASE WHEN q = 39 THEN 2 ELSE 1 END ELSE 0 END AS BIGINT) AS wides,
    CAST(CASE WHEN q % 17 = 0 AND q % 13 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS noballs,
    'p' || {two('s')} AS batter_id, 'p' || {two('o')} AS non_striker_id, 'p' || {two('b')} AS bowler_id,
    CASE WHEN dd = 10 AND tt < 2 THEN 'caught' WHEN dd = 10 AND tt = 2 THEN 'bowled' WHEN dd = 10 AND tt = 3 THEN 'lbw'
         WHEN dd = 10 AND tt = 4 THEN 'run out' WHEN dd = 9 AND tt = 8 THEN 'retired hurt'
         WHEN dd = 9 AND tt = 7 AND q % 5 = 0 THEN 'caught'
         WHEN dd = 9 AND tt = 6 AND q % 9 = 0 THEN 'timed out' END AS kind1,
    CASE WHEN dd = 10 AND tt = 4 AND q % 2 = 0 THEN 'p' || {two('o')}
         WHEN dd = 9 AND tt = 6 AND q % 9 = 0 THEN 'p' || {two('(s + 13) % 60')}
         WHEN (dd = 10 AND tt < 5) OR (dd = 9 AND tt = 8) OR (dd = 9 AND tt = 7 AND q % 5 = 0)
           THEN 'p' || {two('s')} END AS out1,
    CASE WHEN dd = 9 AND tt = 7 AND q % 5 = 0 THEN 'run out' END AS kind2,
    CASE WHEN dd = 9 AND tt = 7 AND q % 5 = 0 THEN 'p' || {two('o')} END AS out2
   FROM balls{x} r) a) c) e"""


def _wickets(x: str) -> str:
    return f"""
SELECT match_id, innings, seq, 0 AS k, kind1 AS kind, out1 AS out_id, batter_id, non_striker_id, bowler_id
FROM d{x} WHERE kind1 IS NOT NULL
UNION ALL SELECT match_id, innings, seq, 1, kind2, out2, batter_id, non_striker_id, bowler_id
FROM d{x} WHERE kind2 IS NOT NULL"""


def _appearances(x: str) -> str:
    """Everyone seen on a ball; ``ord`` orders sightings within an innings."""
    return f"""
SELECT a.*, DENSE_RANK() OVER (PARTITION BY match_id, innings ORDER BY first_ord) AS position FROM (
 SELECT z.*, MIN(ord) OVER (PARTITION BY match_id, innings, person_id) AS first_ord FROM (
  SELECT match_id, innings, seq, seq * 10 AS ord, 0 AS rnk, batter_id AS person_id, CAST(NULL AS VARCHAR) AS kind FROM d{x}
  UNION ALL SELECT match_id, innings, seq, seq * 10 + 1, 1, non_striker_id, NULL FROM d{x}
  UNION ALL SELECT match_id, innings, seq, seq * 10 + 2 + k, 2 + k, out_id, kind FROM w{x}) z) a"""


def _batting_innings(x: str) -> str:
    real = f"kind IS NOT NULL AND kind NOT IN {NOT_OUT}"
    retired = f"kind IN {NOT_OUT}"
    return f"""
SELECT g.match_id, g.innings, g.person_id, position, fmt, format_key, gender, date, team, opposition, venue, chasing,
  runs, balls, fours, sixes, out, outs_other_end,
  CASE WHEN out THEN how WHEN retired_at >= last_seen THEN retired_how ELSE '' END AS dismissal,
  CASE WHEN out AND how NOT IN {NOT_BOWLER} THEN by_id ELSE '' END AS dismissed_by_id
FROM (
 SELECT a.match_id, a.innings, a.person_id, MIN(position) AS position,
  ANY_VALUE(d.fmt) AS fmt, ANY_VALUE(d.format_key) AS format_key, ANY_VALUE(d.gender) AS gender,
  ANY_VALUE(d.date) AS date, ANY_VALUE(d.batting_team) AS team, ANY_VALUE(d.bowling_team) AS opposition,
  ANY_VALUE(d.venue) AS venue, BOOL_OR(d.target IS NOT NULL) AS chasing,
  {total('CASE WHEN rnk = 0 THEN runs_batter END')} AS runs, {n_if('rnk = 0 AND is_faced')} AS balls,
  {n_if('rnk = 0 AND runs_batter = 4')} AS fours, {n_if('rnk = 0 AND runs_batter = 6')} AS sixes,
  COALESCE(BOOL_OR({real}), FALSE) AS out,
  {n_if(f'{real} AND a.person_id <> d.batter_id')} AS outs_other_end,
  ARG_MAX(kind, ord) FILTER (WHERE {real}) AS how, ARG_MAX(d.bowler_id, ord) FILTER (WHERE {real}) AS by_id,
  MAX(a.seq) FILTER (WHERE {retired}) AS retired_at, ARG_MAX(kind, ord) FILTER (WHERE {retired}) AS retired_how,
  MAX(a.seq) AS last_seen
 FROM app{x} a JOIN d{x} d USING (match_id, innings, seq) GROUP BY a.match_id, a.innings, a.person_id) g"""


def _bowling_innings(x: str) -> str:
    return f"""
SELECT match_id, innings, bowler_id AS person_id, ANY_VALUE(fmt) AS fmt, ANY_VALUE(format_key) AS format_key,
  ANY_VALUE(gender) AS gender, ANY_VALUE(date) AS date, ANY_VALUE(bowling_team) AS team,
  ANY_VALUE(batting_team) AS opposition, {total('balls')} AS balls, {total('runs')} AS runs,
  {total('wickets')} AS wickets, {total('wide_balls')} AS wide_balls, {total('noball_balls')} AS noball_balls,
  {n_if('runs = 0 AND balls >= 6')} AS maidens
FROM (SELECT match_id, innings, bowler_id, over_no, ANY_VALUE(fmt) AS fmt, ANY_VALUE(format_key) AS format_key,
  ANY_VALUE(gender) AS gender, ANY_VALUE(date) AS date, ANY_VALUE(bowling_team) AS bowling_team,
  ANY_VALUE(batting_team) AS batting_team, {n_if('is_legal')} AS balls, {total('conceded')} AS runs,
  {n_if('credited_kind IS NOT NULL')} AS wickets, {n_if('wides > 0')} AS wide_balls,
  {n_if('noballs > 0')} AS noball_balls
 FROM d{x} GROUP BY match_id, innings, bowler_id, over_no) GROUP BY match_id, innings, bowler_id"""


def _batting_splits(x: str) -> str:
    home = HOME.format(c="country", t="batting_team")
    pairs = {
        "all": "'all'", "type": "bowling_type", "family": "bowling_family", "phase": "phase",
        "opposition": "bowling_team", "country": "country", "venue": "venue_key", "home": home,
        "innings_no": "CAST(innings AS VARCHAR)",
        "chase": "CASE WHEN fmt <> 'test' THEN CASE WHEN target IS NOT NULL THEN 'chasing' ELSE 'setting' END END",
        "year": "year", "position": "CAST(position AS VARCHAR)",
        "entry": "CASE WHEN faced_before < 15 THEN 'new' WHEN faced_before < 40 THEN 'settling' ELSE 'set' END",
        "type_phase": "CASE WHEN bowling_type <> '' THEN bowling_type || '|' || phase END",
        "vs_bowler": "bowler_id",
    }
    rows = ", ".join(f"{{'dimension': '{k}', 'subject': {v}}}" for k, v in pairs.items())
    return f"""
SELECT person_id, format_key, p.dimension AS dimension, p.subject AS subject, {n_if('is_faced')} AS balls,
  {total('runs_batter')} AS runs, {n_if('striker_out_kind IS NOT NULL')} AS outs,
  {n_if('runs_batter = 4')} AS fours, {n_if('runs_batter = 6')} AS sixes, {n_if('is_dot')} AS dots,
  {n_if('runs_batter = 1')} AS singles, {n_if('is_faced AND NOT is_dot')} AS scoring_balls
FROM (SELECT person_id, format_key, runs_batter, is_faced, is_dot, striker_out_kind, UNNEST([{rows}]) AS p
 FROM (SELECT d.*, a.person_id, a.position,
   COALESCE(SUM(CASE WHEN is_faced THEN 1 ELSE 0 END) OVER (PARTITION BY d.match_id, d.innings, batter_id
     ORDER BY d.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS faced_before
  FROM d{x} d JOIN app{x} a ON a.match_id = d.match_id AND a.innings = d.innings AND a.seq = d.seq AND a.rnk = 0))
WHERE p.subject IS NOT NULL AND p.subject <> '' GROUP BY 1, 2, 3, 4"""


def _bowling_splits(x: str) -> str:
    pairs = {
        "all": "'all'", "hand": "batting_hand", "phase": "phase", "opposition": "batting_team",
        "country": "country", "home": HOME.format(c="country", t="bowling_team"), "year": "year",
        "innings_no": "CAST(innings AS VARCHAR)", "vs_batter": "batter_id",
    }
    rows = ", ".join(f"{{'dimension': '{k}', 'subject': {v}}}" for k, v in pairs.items())
    return f"""
SELECT person_id, format_key, p.dimension AS dimension, p.subject AS subject, {n_if('is_legal')} AS balls,
  {total('conceded')} AS runs, {n_if('credited_kind IS NOT NULL')} AS wickets, {n_if('is_bowler_dot')} AS dots,
  {n_if('runs_batter = 4')} AS fours, {n_if('runs_batter = 6')} AS sixes,
  {total('wides')} AS wides, {total('noballs')} AS noballs
FROM (SELECT d.*, bowler_id AS person_id, UNNEST([{rows}]) AS p FROM d{x} d)
WHERE p.subject IS NOT NULL AND p.subject <> '' GROUP BY 1, 2, 3, 4"""


def _batting_overall(x: str) -> str:
    cols = ", ".join(f"COALESCE(s.{k}, 0) AS {k}" for k in (
        "balls", "runs", "fours", "sixes", "dots", "singles", "scoring_balls"))
    return f"""
SELECT i.person_id, i.format_key, i.innings, {cols}, COALESCE(s.outs, 0) + i.other AS outs
FROM (SELECT person_id, format_key, COUNT(*) AS innings, {total('outs_other_end')} AS other
      FROM bi{x} GROUP BY 1, 2) i
LEFT JOIN (SELECT * FROM bs{x} WHERE dimension = 'all') s USING (person_id, format_key)"""


def _bowling_overall(x: str) -> str:
    return f"""
SELECT s.* EXCLUDE (dimension, subject), i.innings FROM bws{x} s
JOIN (SELECT person_id, format_key, COUNT(*) AS innings FROM wi{x} GROUP BY 1, 2) i USING (person_id, format_key)
WHERE dimension = 'all'"""


def _innings_totals(x: str) -> str:
    return f"""
SELECT match_id, innings, ANY_VALUE(batting_team) AS team, {total('runs_total')} AS runs,
  {total('team_wickets')} AS wickets, {n_if('is_legal')} AS balls, MAX(target) AS target
FROM d{x} GROUP BY match_id, innings"""


def _matches(x: str, mixed: bool) -> str:
    return f"""
SELECT g.*, CASE WHEN winner IS NOT NULL THEN 'win' WHEN tied THEN 'tie' WHEN drawn THEN 'draw' ELSE 'noResult' END AS result_type,
  CASE WHEN winner IS NOT NULL THEN CASE WHEN match_id % 19 = 0 THEN 'D/L' WHEN match_id % 23 = 0 THEN 'Awarded' END END AS method,
  CASE WHEN winner IS NOT NULL AND t1 > t2 AND match_id % 23 <> 0 THEN t1 - t2 END AS margin_runs,
  CASE WHEN winner IS NOT NULL AND t2 > t1 AND match_id % 23 <> 0 THEN GREATEST(10 - w2, 1) END AS margin_wickets,
  (winner IS NOT NULL AND fmt = 'test' AND match_id % 6 = 1) AS margin_innings,
  CASE WHEN tied THEN team1 END AS eliminator,
  CASE WHEN match_id % 11 <> 0 THEN CASE WHEN match_id % 2 = 0 THEN team1 ELSE team2 END END AS toss_winner,
  CASE WHEN match_id % 11 <> 0 THEN CASE WHEN match_id % 3 = 0 THEN 'bat' ELSE 'field' END END AS toss_decision,
  CASE WHEN match_id % 9 = 0 THEN 'World Cup' WHEN match_id % 9 = 1 THEN 'World Cup Qualifier'
       WHEN match_id % 9 = 2 THEN 'Asia Pacific Champions Trophy' ELSE 'Tour' END AS event_name,
  CASE WHEN match_id % 3 = 0 THEN 'Final' END AS event_stage,
  CASE WHEN fmt = 'odi' THEN 50 WHEN fmt = 't20i' THEN 20 END AS scheduled_overs,
  CASE WHEN first_no = 1 THEN team1 ELSE team2 END AS batting_first,
  CASE WHEN fmt = 'test' THEN f_runs
       WHEN f_wickets >= 10 OR f_balls >= CASE WHEN fmt = 'odi' THEN 300 ELSE 120 END THEN f_runs END AS first_innings_total,
  date AS start_date, date AS end_date,
  LOWER(REPLACE(team1, ' ', '-')) || CASE WHEN gender = 'female' THEN '-w' ELSE '-m' END AS team1_id,
  LOWER(REPLACE(team2, ' ', '-')) || CASE WHEN gender = 'female' THEN '-w' ELSE '-m' END AS team2_id
FROM (SELECT f.*, CASE WHEN NOT void AND NOT drawn AND t1 > t2 THEN team1
       WHEN NOT void AND NOT drawn AND t2 > t1 THEN team2 END AS winner,
      (NOT void AND NOT drawn AND t1 = t2) AS tied
 FROM (SELECT k.*, (n < 2 OR match_id % 17 = 0) AS void,
        (NOT (n < 2 OR match_id % 17 = 0) AND fmt = 'test' AND match_id % 4 = 0) AS drawn
  FROM (SELECT j.*, {_header(mixed)} FROM (
   SELECT match_id, {total('CASE WHEN innings = 1 THEN runs END')} AS t1, {total('CASE WHEN innings = 2 THEN runs END')} AS t2,
    {total('CASE WHEN innings = 2 THEN wickets END')} AS w2, COUNT(*) AS n, MIN(innings) AS first_no,
    ARG_MIN(runs, innings) AS f_runs, ARG_MIN(wickets, innings) AS f_wickets, ARG_MIN(balls, innings) AS f_balls,
    {total('runs')} AS all_runs, {total('balls')} AS all_balls, {total('wickets')} AS all_wickets
   FROM it{x} GROUP BY match_id) j) k) f) g"""


def _sides(x: str) -> str:
    tid = "LOWER(REPLACE({0}, ' ', '-')) || CASE WHEN gender = 'female' THEN '-w' ELSE '-m' END"
    return f"""
SELECT z.*, {tid.format('team')} AS team_id, {tid.format('opponent')} AS opponent_id,
  CASE WHEN winner = team THEN 'won' WHEN winner IS NOT NULL THEN 'lost' WHEN result_type = 'tie' THEN 'tied'
       WHEN result_type = 'draw' THEN 'drawn' ELSE 'no_result' END AS outcome
FROM (SELECT m.*, team1 AS team, team2 AS opponent FROM m{x} m
      UNION ALL SELECT m.*, team2, team1 FROM m{x} m) z"""


def _team_records(x: str) -> str:
    vt = """CASE WHEN country = '' THEN 'unknown' WHEN country = team OR (team = 'England' AND country = 'Wales') THEN 'home'
      WHEN country = opponent OR (opponent = 'England' AND country = 'Wales') THEN 'away' ELSE 'neutral' END"""
    pairs = {
        "overall": "'all'", "year": "year", "opponent": "opponent_id", "venue_type": vt,
        "order": "CASE WHEN batting_first = team THEN 'batting_first' ELSE 'chasing' END",
        "toss": "CASE WHEN toss_winner = team THEN 'won' WHEN toss_winner IS NOT NULL THEN 'lost' END",
        "decision": "CASE WHEN toss_winner = team THEN toss_decision END", "venue": "venue_key",
    }
    rows = ", ".join(f"{{'facet': '{k}', 'subject': {v}}}" for k, v in pairs.items())
    return f"""
SELECT r.*, {ratio('won', '(won + lost + tied + drawn)', 100)} AS win_pct FROM (
 SELECT team_id, format_key, f.facet AS facet, f.subject AS subject, MAX(team) AS team, COUNT(*) AS matches,
  {n_if("outcome = 'won'")} AS won, {n_if("outcome = 'lost'")} AS lost, {n_if("outcome = 'tied'")} AS tied,
  {n_if("outcome = 'drawn'")} AS drawn, {n_if("outcome = 'no_result'")} AS no_result,
  MIN(start_date) AS first_date, MAX(end_date) AS last_date,
  ARG_MAX(match_id, end_date || LPAD(CAST(match_id AS VARCHAR), 12, '0')) AS last_match_id,
  CAST(COUNT(CASE WHEN batting_first = team THEN first_innings_total END) AS BIGINT) AS first_innings,
  {total('CASE WHEN batting_first = team THEN first_innings_total END')} AS first_innings_runs
 FROM (SELECT s.*, UNNEST([{rows}]) AS f FROM side{x} s) WHERE f.subject IS NOT NULL GROUP BY 1, 2, 3, 4) r"""


def _names(x: str) -> str:
    return f"""
SELECT DISTINCT match_id, format_key, gender, date, person_id, team FROM (
 SELECT match_id, format_key, gender, date, batter_id AS person_id, batting_team AS team FROM d{x}
 UNION ALL SELECT match_id, format_key, gender, date, non_striker_id, batting_team FROM d{x}
 UNION ALL SELECT match_id, format_key, gender, date, bowler_id, bowling_team FROM d{x})"""


def _careers(x: str) -> str:
    return f"""
SELECT person_id, format_key, p.matches, b.bat_innings, b.runs, b.balls, b.outs, b.fours, b.sixes, b.dots,
 b.highest, b.hundreds, b.fifties, w.bowl_innings, w.bowl_balls, w.runs_conceded, w.wickets, w.maidens,
 w.five_wickets,
 {ratio('b.runs', 'b.outs')} AS bat_avg, {ratio('b.runs', 'b.balls', 100)} AS bat_sr,
 {ratio('w.runs_conceded', 'w.wickets')} AS bowl_avg, {ratio('w.runs_conceded', 'w.bowl_balls', 6)} AS bowl_econ,
 {ratio('w.bowl_balls', 'w.wickets')} AS bowl_sr
FROM (SELECT o.person_id, o.format_key, o.innings AS bat_innings, o.runs, o.balls, o.outs, o.fours, o.sixes, o.dots,
   h.highest, h.hundreds, h.fifties FROM bo{x} o JOIN (SELECT person_id, format_key, MAX(runs) AS highest,
    {n_if('runs >= 100')} AS hundreds, {n_if('runs >= 50 AND runs < 100')} AS fifties FROM bi{x} GROUP BY 1, 2) h
   USING (person_id, format_key) WHERE o.balls >= 60) b
FULL JOIN (SELECT o.person_id, o.format_key, o.innings AS bowl_innings, o.balls AS bowl_balls, o.runs AS runs_conceded,
   o.wickets, h.maidens, h.five_wickets FROM bwo{x} o JOIN (SELECT person_id, format_key, {total('maidens')} AS maidens,
    {n_if('wickets >= 5')} AS five_wickets FROM wi{x} GROUP BY 1, 2) h USING (person_id, format_key)
   WHERE o.balls >= 240 OR o.wickets >= 5) w USING (person_id, format_key)
LEFT JOIN (SELECT person_id, format_key, COUNT(*) AS matches FROM nm{x} GROUP BY 1, 2) p USING (person_id, format_key)"""


def _cut(x: str) -> str:
    """Every ball in an innings within 120 legal balls, ten wickets and the target; the rest goes on as innings apart."""
    before = "COALESCE(SUM({}) OVER (PARTITION BY match_id, innings ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)".format
    legal = before("CASE WHEN is_legal THEN 1 ELSE 0 END")
    return f"""
SELECT o.* EXCLUDE (part), {legal} AS legal_before, {before('team_wickets')} AS wickets_before, {before('runs_total')} AS score_before FROM (
 SELECT n.* REPLACE (CAST(FLOOR({legal} / 6) AS BIGINT) AS over_no) FROM (
  SELECT q.* EXCLUDE (t1, score_all) REPLACE (CASE WHEN part >= 2 THEN match_id + part * {APART} ELSE match_id END AS match_id,
   CASE WHEN part >= 2 THEN 1 ELSE innings END AS innings, CASE WHEN part < 2 AND innings = 2 THEN CAST(t1 AS BIGINT) + 1 END AS target) FROM (
   SELECT k.* REPLACE (CAST(2 * (2 * part + CASE WHEN innings = 2 AND score_all >= t1 + 1 THEN 1 ELSE 0 END) + innings - 1 AS BIGINT) AS part) FROM (
    SELECT z.*, SUM(CASE WHEN innings = 1 AND part = 0 THEN runs_total ELSE 0 END) OVER (PARTITION BY match_id) AS t1 FROM (
     SELECT d.*, FLOOR({legal} / 120) + FLOOR({before('team_wickets')} / 10) AS part, {before('runs_total')} AS score_all FROM d{x} d) z) k) q) n) o"""


def _trace(x: str) -> str:
    """States before each legal ball of matches the model can use."""
    return f"""
SELECT c.match_id, c.format_key, c.date, c.venue_key, c.innings, CAST(legal_before AS BIGINT) AS state_no,
 CAST(120 - legal_before AS BIGINT) AS u, CAST(wickets_before AS BIGINT) AS w, CAST(score_before AS BIGINT) AS r,
 h.t1 AS first_total, (h.w1 >= 10 OR h.b1 >= 120) AS first_complete,
 COALESCE(c.target, h.t1 + 1) AS target, CASE WHEN h.t1 > h.t2 THEN TRUE WHEN h.t2 > h.t1 THEN FALSE END AS batting_first_won
FROM cut c JOIN (SELECT match_id, {total('CASE WHEN innings = 1 THEN runs_total END')} AS t1,
  {total('CASE WHEN innings = 2 THEN runs_total END')} AS t2, {total('CASE WHEN innings = 1 THEN team_wickets END')} AS w1,
  {n_if('innings = 1 AND is_legal')} AS b1, {n_if('innings = 2 AND is_legal')} AS b2, COUNT(DISTINCT innings) AS n
  FROM cut GROUP BY 1) h USING (match_id)
WHERE h.n = 2 AND c.match_id % 17 <> 0 AND b1 > 0 AND b2 > 0 AND is_legal
 AND (h.t1 = h.t2 OR (c.match_id % 19 <> 0 AND c.match_id % 23 <> 0))"""


NEEDS = {
    "balls": (), "d": ("balls",), "w": ("d",), "app": ("w",), "bi": ("app",), "wi": ("d",),
    "bs": ("app",), "bws": ("d",), "bo": ("bi", "bs"), "bwo": ("wi", "bws"), "it": ("d",),
    "cut": ("d",), "trace": ("cut",), "m": ("it",), "side": ("m",), "tr": ("side",), "nm": ("d",), "car": ("bo", "bwo", "nm"),
}


def _cte(name: str, mixed: bool) -> str:
    x = "x" if mixed else ""
    return {
        "balls": lambda: _balls(mixed), "d": lambda: _deliveries(x, mixed),
        "w": lambda: _wickets(x), "app": lambda: _appearances(x),
        "bi": lambda: _batting_innings(x), "wi": lambda: _bowling_innings(x),
        "bs": lambda: _batting_splits(x), "bws": lambda: _bowling_splits(x),
        "bo": lambda: _batting_overall(x), "bwo": lambda: _bowling_overall(x),
        "it": lambda: _innings_totals(x), "m": lambda: _matches(x, mixed),
        "cut": lambda: _cut(x), "trace": lambda: _trace(x),
        "side": lambda: _sides(x), "tr": lambda: _team_records(x), "nm": lambda: _names(x),
        "car": lambda: _careers(x),
    }[name]()


def sql(body: str, *names: str, mixed: bool = False, extra: dict[str, str] | None = None) -> str:
    """A query over the shared blocks; mixed ones carry an ``x`` suffix."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS[name]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    x = "x" if mixed else ""
    parts = [f"{n}{x} AS ({_cte(n, mixed)})" for n in order]
    parts += [f"{n} AS ({q})" for n, q in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body
