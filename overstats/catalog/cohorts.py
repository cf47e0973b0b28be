"""Queries that judge players against their cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from overstats.catalog.base import query, ratio, sql
from overstats.catalog.players import (
    bat_overall, bat_splits, batted, bowl_innings, bowl_overall, bowl_splits, careers_table,
)
from overstats.functions import rates
from overstats.operators import cohort, players, ranking
from overstats.session import materialise
from overstats.sources import sinks

METRIC = {
    "average": ratio("runs", "{o}"),
    "strike_rate": {"batting": f"COALESCE({ratio('runs', 'balls', 100)}, 0)", "bowling": ratio("balls", "{o}")},
    "balls_per_dismissal": ratio("balls", "{o}"),
    "economy": f"COALESCE({ratio('runs', 'balls', 6)}, 0)",
    "dot_pct": f"COALESCE({ratio('dots', 'balls', 100)}, 0)",
    "boundary_pct": f"COALESCE({ratio('fours + sixes', 'balls', 100)}, 0)",
}


def metric(name: str, discipline: str) -> str:
    value = METRIC[name]
    value = value[discipline] if isinstance(value, dict) else value
    return value.format(o="outs" if discipline == "batting" else "wickets")


def judged_sql(discipline: str) -> str:
    bat = discipline == "batting"
    table, overall = ("bs", "bo") if bat else ("bws", "bwo")
    gate, pool, claim, k = (60, 600, 150, 200) if bat else (90, 900, 240, 300)
    parts = [
        f"""SELECT s.person_id, s.format_key, '{key}' AS dimension_key, {i} AS ordinal, s.subject, s.balls, '{m}' AS metric,
  {str(up).upper()} AS hib, {metric(m, discipline)} AS value, b.baseline
 FROM {table} s JOIN (SELECT person_id, format_key, {metric(m, discipline)} AS baseline FROM {table} WHERE dimension = 'all') b USING (person_id, format_key)
 WHERE s.dimension = '{dim}'"""
        for i, (key, dim, m, up) in enumerate(cohort.BATTING_JUDGED if bat else cohort.BOWLING_JUDGED)
    ]
    w = f"(j.balls / (j.balls + CAST({k} AS DOUBLE)))"
    return f"""SELECT *, shrunk / baseline AS ratio, career >= {pool} AS in_pool, (balls >= {claim} AND career >= {claim}) AS claimable,
 '{discipline}' AS discipline FROM (SELECT j.*, o.balls AS career,
  {w} * value + (CAST(1 AS DOUBLE) - {w}) * baseline AS shrunk
 FROM ({' UNION ALL '.join(parts)}) j JOIN {overall} o USING (person_id, format_key)
 WHERE value IS NOT NULL AND baseline > 0 AND j.balls >= {gate})"""


G = "format_key, discipline, dimension_key, subject"


def claims_sql(discipline: str) -> str:
    claim = 150 if discipline == "batting" else 240
    extra = {
        "jud": judged_sql(discipline),
        "pool": f"""SELECT {G}, COUNT(*) AS n, QUANTILE_CONT(ratio, 0.5) - 1 AS cohort_change, QUANTILE_CONT(shrunk, 0.5) AS cohort_median
  FROM jud WHERE in_pool GROUP BY ALL""",
        "rk": f"""SELECT j.*, n, cohort_change, cohort_median, below, ties FROM (SELECT *,
   COALESCE(SUM(CASE WHEN in_pool THEN 1 ELSE 0 END) OVER (PARTITION BY {G} ORDER BY ratio RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES), 0)
    - CASE WHEN in_pool THEN 1 ELSE 0 END AS below,
   SUM(CASE WHEN in_pool THEN 1 ELSE 0 END) OVER (PARTITION BY {G}, ratio) AS ties
  FROM jud WHERE in_pool OR claimable) j JOIN pool USING ({G}) WHERE claimable AND n >= 8""",
        "pc": """SELECT *, CASE WHEN hib THEN pct ELSE CAST(100 AS DOUBLE) - pct END AS percentile,
   CASE WHEN hib THEN eff ELSE -eff END AS effect FROM (SELECT *, CAST(100 AS DOUBLE) * ((below + below + ties) / CAST(2 AS DOUBLE)) / n AS pct,
   (shrunk - baseline) / baseline AS eff FROM rk)""",
        "kinds": f"""SELECT *, CASE WHEN percentile >= 70 AND effect > 0 THEN 'strength' WHEN percentile <= 30 AND effect < 0 THEN 'weakness' END AS kind,
   CASE WHEN balls >= {claim * 3} THEN 'high' WHEN balls >= {claim} * CAST(1.5 AS DOUBLE) THEN 'medium' ELSE 'low' END AS confidence FROM pc
   WHERE ABS(effect) >= CAST(0.04 AS DOUBLE)""",
        "sev": """SELECT *, (CASE WHEN kind = 'strength' THEN ROUND_EVEN(percentile, 1) ELSE CAST(100 AS DOUBLE) - ROUND_EVEN(percentile, 1) END)
   * (CASE confidence WHEN 'high' THEN CAST(1 AS DOUBLE) WHEN 'medium' THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.55 AS DOUBLE) END) AS severity
   FROM kinds WHERE kind IS NOT NULL""",
    }
    return sql(f"""SELECT person_id, format_key, kind, rank, dimension_key, subject, metric, value, baseline, cohort_median,
 percentile, balls, confidence, cohort_change FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY person_id, format_key, kind
  ORDER BY severity DESC, ordinal, subject) AS rank FROM sev) WHERE rank <= 12""",
               *(("bo", "bs") if discipline == "batting" else ("bwo", "bws")), extra=extra)


CLAIM = ("person_id", "format_key", "kind", "rank", "dimension_key", "subject", "metric", "value",
         "baseline", "cohort_median", "percentile", "balls", "confidence", "cohort_change")


def judged(t, discipline):
    only = cohort.judged_dimensions(discipline)
    splits = bat_splits(t, only=only) if discipline == "batting" else bowl_splits(t, only=only)
    return cohort.judged_splits(splits, discipline)


JUDGED = ("person_id", "format_key", "dimension_key", "subject", "balls", "metric", "value",
          "baseline", "shrunk", "ratio", "in_pool", "claimable")


@query(sql(f"SELECT {', '.join(JUDGED)} FROM jud", "bo", "bs", extra={"jud": judged_sql("batting")}))
def shrunk_batting_splits(t):
    return judged(t, "batting").select(*JUDGED)


@query(sql(f"SELECT {', '.join(JUDGED)} FROM jud", "bwo", "bws", extra={"jud": judged_sql("bowling")}))
def shrunk_bowling_splits(t):
    return judged(t, "bowling").select(*JUDGED)


@query(claims_sql("batting"))
def batting_claims(t):
    return cohort.claims(judged(t, "batting")).select(*CLAIM)


@query(claims_sql("bowling"))
def bowling_claims(t):
    return cohort.claims(judged(t, "bowling")).select(*CLAIM)


def sentence_sql() -> str:
    """Sentences with C-style formats; halves round to even as they do there."""
    def digits(x: str) -> str:
        return f"CASE WHEN metric = 'balls_per_dismissal' THEN PRINTF('%.0f', {x}) ELSE PRINTF('%.1f', {x}) END"

    word = "CASE metric WHEN 'strike_rate' THEN 'strike rate' WHEN 'balls_per_dismissal' THEN 'balls per dismissal' ELSE metric END"
    return claims_sql("batting").replace(
        "SELECT person_id, format_key, kind, rank, dimension_key, subject, metric, value, baseline, cohort_median,\n"
        " percentile, balls, confidence, cohort_change FROM (",
        f"""SELECT person_id, format_key, kind, rank, {word} || ' of ' || {digits('value')} || ', ' || {digits('ABS(value - baseline)')}
 || CASE WHEN value > baseline THEN ' above' ELSE ' below' END || ' their ' || {word} || ' of ' || {digits('baseline')}
 || ' on all balls faced' AS opening FROM (""")


@query(sentence_sql())
def claim_sentences(t):
    """The opening of each claim's sentence: figure, difference and baseline."""
    rows = cohort.claim_text(cohort.claims(judged(t, "batting")))
    opening = F.regexp_extract("text", r": ((?:average|strike rate|balls per) .*? on all balls faced)", 1)
    return rows.select("person_id", "format_key", "kind", "rank", opening.alias("opening"))


def profile_sql(discipline: str) -> str:
    bat = discipline == "batting"
    table, overall = ("bs", "bo") if bat else ("bws", "bwo")
    gate, pool, split, k = (150, 600, 60, 200) if bat else (240, 900, 90, 300)
    axes = cohort.BATTING_AXES if bat else cohort.BOWLING_AXES
    whole = " UNION ALL ".join(
        f"SELECT person_id, format_key, balls, balls AS career, '{a}' AS axis, '{label}' AS label, {str(up).upper()} AS hib, "
        f"{metric(m, discipline)} AS value, balls >= {pool} AS member, TRUE AS asking FROM {overall}"
        for a, label, d, s, m, up in axes if d is None)
    parts = " UNION ALL ".join(
        f"""SELECT s.person_id, s.format_key, s.balls, o.balls AS career, '{a}' AS axis, '{label}' AS label, {str(up).upper()} AS hib,
  {metric(m, discipline).replace('balls', 's.balls').replace('runs', 's.runs').replace('outs', 's.outs').replace('wickets', 's.wickets')} AS value, b.base
  FROM {table} s JOIN {overall} o USING (person_id, format_key)
  JOIN (SELECT person_id, format_key, {metric(m, discipline)} AS base FROM {table} WHERE dimension = 'all') b USING (person_id, format_key)
  WHERE s.dimension = '{d}' AND s.subject = '{s}'"""
        for a, label, d, s, m, up in axes if d is not None)
    w = f"(balls / (balls + CAST({k} AS DOUBLE)))"
    extra = {
        "sub": f"SELECT * FROM ({parts}) WHERE value IS NOT NULL",
        "al": f"""SELECT * FROM ({whole}) WHERE value IS NOT NULL
 UNION ALL SELECT person_id, format_key, balls, career, axis, label, hib, {w} * value + (CAST(1 AS DOUBLE) - {w}) * base, TRUE, FALSE
  FROM sub WHERE career >= {pool} AND balls >= {split} AND base > 0
 UNION ALL SELECT person_id, format_key, balls, career, axis, label, hib, value, FALSE, TRUE FROM sub""",
        "rk": """SELECT *, SUM(CASE WHEN member THEN 1 ELSE 0 END) OVER (PARTITION BY format_key, axis) AS n,
  SUM(CASE WHEN member THEN 1 ELSE 0 END) OVER (PARTITION BY format_key, axis, value) AS ties,
  SUM(CASE WHEN member THEN 1 ELSE 0 END) OVER (PARTITION BY format_key, axis ORDER BY value)
   - SUM(CASE WHEN member THEN 1 ELSE 0 END) OVER (PARTITION BY format_key, axis, value) AS below FROM al""",
    }
    pct = "CAST(100 AS DOUBLE) * ((below + below + ties) / CAST(2 AS DOUBLE)) / n"
    return sql(f"""SELECT person_id, format_key, '{discipline}' AS discipline, axis, label, value,
 CASE WHEN hib THEN {pct} ELSE CAST(100 AS DOUBLE) - {pct} END AS percentile, balls FROM rk
 WHERE asking AND career >= {gate} AND balls >= {gate // 4} AND n >= 8""",
               *(("bo", "bs") if bat else ("bwo", "bws")), extra=extra)


@query(profile_sql("batting"))
def batting_profiles(t):
    splits = materialise(bat_splits(t), "splits")
    overall = players.batting_overall(batted(t), players.whole(splits))
    return cohort.profiles(splits, overall, "batting")


@query(profile_sql("bowling"))
def bowling_profiles(t):
    splits = materialise(bowl_splits(t), "splits")
    overall = players.bowling_overall(bowl_innings(t), players.whole(splits))
    return cohort.profiles(splits, overall, "bowling")


def _millionths(rows):
    points = [f"p{q}" for q in (10, 25, 50, 75, 90)]
    return rows.select("format_key", "discipline", "metric", "n", *[
        F.floor(F.col(p) * F.lit(1e6) + F.lit(0.5)).alias(f"{p}_e6") for p in points])


def reference_sql(discipline: str) -> str:
    table, pool = ("bo", 600) if discipline == "batting" else ("bwo", 900)
    rows = " UNION ALL ".join(
        f"SELECT format_key, '{m}' AS metric, {metric(m, discipline)} AS v FROM {table} WHERE balls >= {pool}"
        for m in cohort.REFERENCE_METRICS[discipline])
    points = ", ".join(f"CAST(FLOOR(QUANTILE_CONT(v, {q}) * 1e6 + 0.5) AS BIGINT) AS p{round(q * 100)}_e6" for q in (0.1, 0.25, 0.5, 0.75, 0.9))
    return sql(f"""SELECT format_key, '{discipline}' AS discipline, metric, COUNT(*) AS n, {points} FROM ({rows})
 WHERE v IS NOT NULL GROUP BY 1, 2, 3 HAVING COUNT(*) >= 8""", table)


@query(reference_sql("batting"))
def batting_cohort_quantiles(t):
    return _millionths(cohort.reference_quantiles(bat_overall(t), "batting"))


@query(reference_sql("bowling"))
def bowling_cohort_quantiles(t):
    return _millionths(cohort.reference_quantiles(bowl_overall(t), "bowling"))


@query(sql(f"""SELECT person_id, subject, balls, dots, CASE WHEN balls = 0 THEN CAST(0 AS DOUBLE) ELSE GREATEST(CAST(0 AS DOUBLE), c - m) END AS low,
 CASE WHEN balls = 0 THEN CAST(1 AS DOUBLE) ELSE LEAST(CAST(1 AS DOUBLE), c + m) END AS high FROM (
 SELECT *, (p + zz / (CAST(2 AS DOUBLE) * nn)) / den AS c,
  CAST(1.96 AS DOUBLE) * SQRT(p * (CAST(1 AS DOUBLE) - p) / nn + zz / (CAST(4 AS DOUBLE) * nn * nn)) / den AS m FROM (
  SELECT *, dots / nn AS p, CAST(1 AS DOUBLE) + zz / nn AS den FROM (
   SELECT person_id, subject, balls, dots, CAST(balls AS DOUBLE) AS nn, CAST(1.96 AS DOUBLE) * CAST(1.96 AS DOUBLE) AS zz FROM bs WHERE dimension = 'type')))""", "bs"))
def dot_ball_intervals(t):
    low, high = rates.wilson_interval(F.col("dots"), F.col("balls"))
    return bat_splits(t).where("dimension = 'type'").select(
        "person_id", "subject", "balls", "dots", low.alias("low"), high.alias("high"))


@query(sql("""SELECT dimension, COUNT(*) AS n, CAST(FLOOR(AVG(balls) * 1e6 + 0.5) AS BIGINT) AS mean_e6,
 CAST(FLOOR(CASE WHEN COUNT(*) < 2 THEN 0 ELSE STDDEV_SAMP(balls) END * 1e6 + 0.5) AS BIGINT) AS stdev_e6, QUANTILE_CONT(balls, 0.5) AS median
FROM bs GROUP BY 1""", "bs"))
def split_moments(t):
    whole = lambda c: F.floor(F.col(c) * F.lit(1e6) + F.lit(0.5))
    rows = materialise(bat_splits(t), "splits").withColumn("size", F.col("balls").cast("double"))
    out = ranking.moments(rows, ("dimension",), "size")
    n = rows.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"))
    return out.join(n, "dimension").select(
        "dimension", "n", whole("mean").alias("mean_e6"), whole("stdev").alias("stdev_e6"), "median")


def _named(t):
    """People under invented names."""
    return players.squads_from_deliveries(t.hold()).select("person_id").distinct().withColumn("name", F.concat(F.lit("Player "), F.col("person_id")))


def _documents(t):
    splits, cuts = materialise(bat_splits(t), "splits"), materialise(bowl_splits(t), "splits")
    overall = players.batting_overall(batted(t), players.whole(splits))
    return sinks.player_documents(
        _named(t), careers_table(t, False), splits, cuts, cohort.claims(cohort.judged_splits(splits, "batting")),
        cohort.profiles(splits, overall, "batting"))


SECTIONS = {
    "docs": f"""SELECT c.person_id, c.format_key, 'Player ' || c.person_id AS name, TRIM(REGEXP_REPLACE(LOWER('Player ' || c.person_id), '[^a-z0-9]+', '-', 'g'), '-') || '-' || SUBSTR(c.person_id, 1, 8) AS slug,
      CAST(matches AS BIGINT) AS matches, c.runs, wickets, COALESCE(a.n, 0) AS n_batting, COALESCE(a.balls, 0) AS batting_balls, a.top AS first_batting, COALESCE(b.n, 0) AS n_bowling, COALESCE(b.balls, 0) AS bowling_balls,
      COALESCE(d.n, 0) AS n_claims, d.top AS first_claim, COALESCE(e.n, 0) AS n_axes, e.top AS axes FROM car c
      LEFT JOIN (SELECT person_id, format_key, COUNT(*) AS n, CAST(SUM(balls) AS BIGINT) AS balls, MIN(dimension || '|' || subject) AS top FROM bs WHERE dimension <> 'all' GROUP BY 1, 2) a USING (person_id, format_key)
      LEFT JOIN (SELECT person_id, format_key, COUNT(*) AS n, CAST(SUM(balls) AS BIGINT) AS balls FROM bws WHERE dimension <> 'all' GROUP BY 1, 2) b USING (person_id, format_key)
      LEFT JOIN (SELECT person_id, format_key, COUNT(*) AS n, MIN(kind || '|' || rank) AS top FROM ({claims_sql("batting")}) GROUP BY 1, 2) d USING (person_id, format_key)
      LEFT JOIN (SELECT person_id, format_key, COUNT(*) AS n, STRING_AGG(axis, ',' ORDER BY axis) AS top FROM ({profile_sql("batting")}) GROUP BY 1, 2) e USING (person_id, format_key)""",
}


@query(sql("SELECT * FROM docs", "car", extra=SECTIONS))
def player_documents(t):
    """Nested documents, seen by their sections' sizes, sums and first entries."""
    c = F.col
    balls = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda a, x: a + x["balls"].cast("bigint"))
    both = lambda part, x, y: F.array_min(F.transform(part, lambda r: F.concat(r[x], F.lit("|"), r[y].cast("string"))))
    return _documents(t).select(
        "person_id", "format_key", "name", "slug", "matches", "runs", "wickets", F.size("batting").alias("n_batting"), balls("batting").alias("batting_balls"),
        both("batting", "dimension", "subject").alias("first_batting"), F.size("bowling").alias("n_bowling"), balls("bowling").alias("bowling_balls"),
        F.size("claims").alias("n_claims"), both("claims", "kind", "rank").alias("first_claim"), F.size("profile").alias("n_axes"),
        F.when(F.size("profile") > 0, F.array_join(F.array_sort(c("profile.axis")), ",")).alias("axes"))


@query(sql("""SELECT person_id, MAX(name) AS name, MAX(slug) AS slug, MAX(COALESCE(runs, 0)) AS best_runs, STRING_AGG(format_key, ',' ORDER BY format_key) AS formats,
 CAST(SUM(n_claims) AS BIGINT) AS claims, CAST(SUM(wickets) AS BIGINT) AS wickets FROM docs GROUP BY 1""", "car", extra=SECTIONS))
def player_index(t):
    """One small row per person over their documents."""
    total = lambda field: F.aggregate("formats", F.lit(None).cast("bigint"), lambda a, x: F.when(x[field].isNull(), a).otherwise(F.coalesce(a, F.lit(0).cast("bigint")) + x[field].cast("bigint")))
    return sinks.player_index(_documents(t)).select(
        "person_id", "name", "slug", "best_runs", F.array_join(F.col("formats.format_key"), ",").alias("formats"), total("claims").alias("claims"), total("wickets").alias("wickets"))
