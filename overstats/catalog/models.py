"""Queries over the win model.

Scoring is checked against SQL with a model given by formula (the same
formula on both sides); fitting is checked against numpy in the tests.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from overstats.catalog.base import n_if, query, ratio, sql, total
from overstats.operators import matches as match_ops
from overstats.operators import state, winmodel
from overstats.session import materialise

THETA = (-0.3, -4.2, 1.1, 0.4, -0.6)


def _traces(t):
    rows = t.limited
    matches = match_ops.match_rows(t.headers(rows=rows), match_ops.innings_totals(rows))
    usable = winmodel.usable_matches(matches, match_ops.innings_totals(rows))
    return winmodel.traces(rows, usable)


def _resource(u: int, w: int) -> float:
    return (170.0 - 15.0 * w) * (1.0 - math.exp(-0.009 * u))


def _win(need: float) -> float:
    x = math.log(need / max(_resource(120, 0), 0.5))
    z = THETA[0] + THETA[1] * x + THETA[2] * x + THETA[3] + THETA[4] * x * 0
    return 1.0 - 1.0 / (1.0 + math.exp(-z))


def given_model(t):
    """A model of the fitted ones' shape, from a formula."""
    return t.spark.createDataFrame(
        [("t20i-m", 120, list(THETA),
          [[_resource(u, w) for u in range(121)] for w in range(10)],
          [1.5 + 0.1 * w for w in range(10)],
          [_win(total + 1) for total in range(601)])],
        "format_key string, max_balls int, theta array<double>, resources array<array<double>>, "
        "dispersion array<double>, first_innings_win array<double>",
    )


D = "CAST({} AS DOUBLE)".format
RES = f"CASE WHEN {{w}} >= 10 OR {{u}} <= 0 THEN {D(0)} ELSE ({D(170)} - {D(15)} * {{w}}) * ({D(1)} - EXP({D(-0.009)} * {{u}})) END"


def chase_sql(u: str, w: str, need: str) -> str:
    res = RES.format(u=u, w=w)
    x = f"LN({need} / GREATEST({res}, {D(0.5)}))"
    f = f"({u} / {D(120)})"
    z = f"({D(-0.3)} + {D(-4.2)} * {x} + {D(1.1)} * {x} * {f} + {D(0.4)} * {f} + {D(-0.6)} * {x} * {w} / {D(10)})"
    return f"CASE WHEN {need} <= 0 THEN {D(1)} WHEN {w} >= 10 OR {u} <= 0 THEN {D(0)} ELSE {D(1)} / ({D(1)} + EXP(-{z})) END"


FIW = f"SELECT n AS t, {D(1)} - {chase_sql('120', '0', '(n + 1)')} AS p FROM (SELECT UNNEST(GENERATE_SERIES(0, 600)) AS n)"
#: P(batting first wins) of distinct first-innings states (u, w, r).
FIRST = f"""SELECT u, w, r, CASE WHEN var <= 0.25 THEN (SELECT p FROM fiw WHERE t = LEAST(ROUND_EVEN(mean, 0), 600)) ELSE integ END AS p FROM (
 SELECT s.*, (SELECT SUM(EXP({D(-0.5)} * POW((t - mean) / SQRT(var), 2)) * p) / SUM(EXP({D(-0.5)} * POW((t - mean) / SQRT(var), 2)))
   FROM fiw WHERE t BETWEEN GREATEST(r, TRUNC(mean - 4 * SQRT(var))) AND LEAST(600, TRUNC(mean + 4 * SQRT(var)) + 1)) AS integ
 FROM (SELECT *, r + res AS mean, ({D(1.5)} + {D(0.1)} * w) * res AS var FROM (
  SELECT DISTINCT u, w, r, {RES.format(u='u', w='w')} AS res FROM first_states)) s)"""
BILLION = "CAST(FLOOR(({}) * 1e9 + 0.5) AS BIGINT)".format


def billion(col):
    return F.floor(col * F.lit(1e9) + F.lit(0.5))


TRACE = "match_id, innings, state_no, u, w, r, first_total, first_complete, target, batting_first_won"


@query(sql(f"SELECT {TRACE} FROM trace", "trace"))
def match_traces(t):
    return _traces(t).select(*TRACE.split(", "))


@query(sql(f"""SELECT w, u, COUNT(*) AS n, {total('first_total - r')} AS sy, {total('(first_total - r) * (first_total - r)')} AS syy
FROM trace WHERE innings = 1 AND first_complete GROUP BY 1, 2""", "trace"))
def resource_moments(t):
    weighted = winmodel.weighted_moments(winmodel.first_innings_moments(_traces(t)))
    c = F.col
    return weighted.select("w", "u", *[c(k).cast("bigint").alias(k) for k in ("n", "sy", "syy")])


WEIGHT = ("POW(CAST(0.5 AS DOUBLE), ((CAST(SUBSTR(newest, 1, 4) AS INT) - CAST(SUBSTR(date, 1, 4) AS INT))"
          " + (CAST(SUBSTR(newest, 6, 2) AS INT) - CAST(SUBSTR(date, 6, 2) AS INT)) / CAST(12 AS DOUBLE)) / CAST(8 AS DOUBLE))")


@query(sql(f"""SELECT w, u, CAST(FLOOR(SUM({WEIGHT}) * 1e6 + 0.5) AS BIGINT) AS n_e6,
 CAST(FLOOR(SUM({WEIGHT} * (first_total - r)) * 1e6 + 0.5) AS BIGINT) AS sy_e6
FROM (SELECT *, MAX(date) OVER () AS newest FROM trace WHERE innings = 1 AND first_complete) GROUP BY 1, 2""", "trace"))
def recency_weighted_moments(t):
    """Moments with an eight-year half-life."""
    weighted = winmodel.weighted_moments(winmodel.first_innings_moments(_traces(t)), (8.0,))
    whole = lambda k: F.floor(F.col(k) * F.lit(1e6) + F.lit(0.5)).alias(f"{k}_e6")
    return weighted.select("w", "u", whole("n"), whole("sy"))


CURVES = {
    "mom": """SELECT w, u, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(first_total - r) AS DOUBLE) / COUNT(*) AS y,
      CAST(SUM(first_total - r) AS DOUBLE) AS sy, CAST(SUM((first_total - r) * (first_total - r)) AS DOUBLE) AS syy
      FROM trace WHERE innings = 1 AND first_complete GROUP BY 1, 2""",
    "grid": """SELECT i, POW(CAST(10 AS DOUBLE), CAST(-4 AS DOUBLE) + CAST(3 AS DOUBLE) * i / CAST(399 AS DOUBLE)) AS b
      FROM (SELECT UNNEST(GENERATE_SERIES(0, 399)) AS i)""",
    "points": """SELECT w, i, b, n, y, 1 - EXP(-b * u) AS g FROM mom, grid""",
    "fitted": """SELECT w, ARG_MIN(z, err) AS z, ARG_MIN(b, err) AS b, MAX(k) AS k FROM (
      SELECT w, i, b, z, COUNT(*) AS k, SUM(n * (y - z * g) * (y - z * g)) AS err FROM points
       JOIN (SELECT w, i, SUM(n * y * g) / SUM(n * g * g) AS z FROM points GROUP BY 1, 2) USING (w, i) GROUP BY 1, 2, 3, 4)
      GROUP BY w HAVING MAX(k) >= 3""",
    "curves": """SELECT v.w, COALESCE(LAST_VALUE(z IGNORE NULLS) OVER (ORDER BY v.w), 0) AS z,
      COALESCE(LAST_VALUE(b IGNORE NULLS) OVER (ORDER BY v.w), CAST(0.01 AS DOUBLE)) AS b
      FROM (SELECT UNNEST(GENERATE_SERIES(0, 9)) AS w WHERE (SELECT COUNT(*) FROM mom) > 0) v LEFT JOIN fitted f ON f.w = v.w""",
}


@query(sql("SELECT CAST(w AS BIGINT) AS w, CAST(FLOOR(z * 1e6 + 0.5) AS BIGINT) AS z_e6, CAST(FLOOR(b * 1e9 + 0.5) AS BIGINT) AS b_e9 FROM curves",
           "trace", extra=CURVES))
def resource_curves(t):
    weighted = materialise(winmodel.weighted_moments(winmodel.first_innings_moments(_traces(t))), "moments")
    c = F.col
    return winmodel.fit_curves(weighted).select(
        "w", F.floor(c("z") * F.lit(1e6) + F.lit(0.5)).alias("z_e6"), billion(c("b")).alias("b_e9"))


RESOURCES = CURVES | {
    "res": """SELECT w, u, MIN(raw) OVER (PARTITION BY u ORDER BY w) AS resource FROM (
      SELECT w, u, z * (1 - EXP(-b * u)) AS raw FROM curves, (SELECT UNNEST(GENERATE_SERIES(0, 120)) AS u))""",
}


@query(sql("SELECT CAST(w AS BIGINT) AS w, CAST(u AS BIGINT) AS u, CAST(FLOOR(resource * 1e6 + 0.5) AS BIGINT) AS resource_e6 FROM res",
           "trace", extra=RESOURCES))
def resource_tables(t):
    weighted = materialise(winmodel.weighted_moments(winmodel.first_innings_moments(_traces(t))), "moments")
    table = winmodel.resource_table(winmodel.fit_curves(weighted))
    return table.select("w", "u", F.floor(F.col("resource") * F.lit(1e6) + F.lit(0.5)).alias("resource_e6"))


@query(sql("""SELECT CAST(w AS BIGINT) AS w, CAST(FLOOR(COALESCE(LAST_VALUE(d IGNORE NULLS) OVER (ORDER BY w), 1) * 1e6 + 0.5) AS BIGINT) AS dispersion_e6
FROM (SELECT v.w, CASE WHEN den > 0 THEN num / den END AS d FROM (SELECT DISTINCT w FROM res) v LEFT JOIN (
 SELECT m.w, SUM(syy - n * y * y) AS num, SUM(n * resource) AS den FROM mom m JOIN res USING (w, u) GROUP BY 1) q ON q.w = v.w)""",
           "trace", extra=RESOURCES))
def dispersions(t):
    weighted = materialise(winmodel.weighted_moments(winmodel.first_innings_moments(_traces(t))), "moments")
    table = materialise(winmodel.resource_table(winmodel.fit_curves(weighted)), "resources")
    return winmodel.dispersions(weighted, table).select(
        "w", F.floor(F.col("dispersion") * F.lit(1e6) + F.lit(0.5)).alias("dispersion_e6"))


@query(sql(f"""SELECT u // 6 AS u_bin, w, CAST(ROUND_EVEN(x / CAST(0.05 AS DOUBLE), 0) AS BIGINT) AS x_bin, COUNT(*) AS trials, {n_if('NOT batting_first_won')} AS wins
FROM (SELECT *, LN((target - r) / GREATEST(resource, CAST(0.5 AS DOUBLE))) AS x FROM trace t JOIN res USING (w, u)
 WHERE innings = 2 AND batting_first_won IS NOT NULL AND target - r > 0 AND w < 10 AND u > 0) GROUP BY 1, 2, 3""", "trace", extra=RESOURCES))
def chase_bins(t):
    traces = materialise(_traces(t), "traces")
    weighted = materialise(winmodel.weighted_moments(winmodel.first_innings_moments(traces)), "moments")
    table = winmodel.resource_table(winmodel.fit_curves(weighted))
    bins = winmodel.feature_bins(winmodel.chase_counts(traces), table)
    c = F.col
    return bins.select("u_bin", "w", "x_bin", c("trials").cast("bigint").alias("trials"),
                       c("wins").cast("bigint").alias("wins"))


def _scored(t):
    states = state.replay_states(t.limited, F.lit(120))
    return winmodel.score_states(states, given_model(t))


STATES = """SELECT match_id, innings, seq, target, 120 - CAST(SUM(CASE WHEN is_legal THEN 1 ELSE 0 END) OVER v AS BIGINT) AS u,
 CAST(SUM(team_wickets) OVER v AS BIGINT) AS w, CAST(SUM(runs_total) OVER v AS BIGINT) AS r, over_no, is_legal
 FROM cut WINDOW v AS (PARTITION BY match_id, innings ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
SCORED = {
    "st": STATES, "first_states": "SELECT * FROM st WHERE innings = 1", "fiw": FIW, "first_p": FIRST,
    "scored": f"""SELECT s.*, p FROM st s JOIN first_p USING (u, w, r) WHERE innings = 1
      UNION ALL SELECT s.*, {D(1)} - {chase_sql('u', 'w', '(target - r)')} FROM st s WHERE innings = 2""",
}


@query(sql(f"SELECT match_id, innings, seq, {BILLION('p')} AS p_e9 FROM scored", "cut", extra=SCORED))
def win_curve(t):
    """P(side batting first wins) after every ball, for a given model."""
    return _scored(t).select("match_id", "innings", "seq", billion(F.col("p")).alias("p_e9"))


@query(sql(f"""SELECT match_id, innings, seq, {BILLION('r + res')} AS mean_e9, {BILLION('GREATEST(r, r + res - 1.2816e0 * SQRT(var))')} AS low_e9,
 {BILLION('r + res + 1.2816e0 * SQRT(var)')} AS high_e9 FROM (SELECT *, ({D(1.5)} + {D(0.1)} * w) * res AS var FROM (
 SELECT *, {RES.format(u='u', w='w')} AS res FROM st WHERE innings = 1))""", "cut", extra={"st": STATES}))
def projected_totals(t):
    c = F.col
    states = state.replay_states(t.limited, F.lit(120)).where("innings = 1")
    rows = states.join(F.broadcast(given_model(t)), "format_key")
    out = winmodel.projection(c("balls_left"), c("wickets"), c("runs"))
    return rows.select("match_id", "innings", "seq", billion(out["projected"]).alias("mean_e9"),
                       billion(out["projected_low"]).alias("low_e9"),
                       billion(out["projected_high"]).alias("high_e9"))


@query(sql(f"""SELECT match_id, 1 AS innings, 0 AS seq, {BILLION('x')} AS x_e9, {BILLION('p')} AS p_e9, score, over_end FROM (
 SELECT DISTINCT match_id, CAST(0 AS DOUBLE) AS x, (SELECT p FROM start_p) AS p, 'Start' AS score, TRUE AS over_end FROM cut)
UNION ALL SELECT match_id, innings, seq, {BILLION(f'((innings - 1) * {D(20)} + (120 - u) / {D(6)})')},
 {BILLION(f'CASE WHEN from_end > 1 THEN p WHEN w1 THEN {D(1)} ELSE {D(0)} END')}, CAST(r AS VARCHAR) || '/' || CAST(w AS VARCHAR),
 is_legal AND (120 - u) % 6 = 0 FROM (SELECT s.*, ROW_NUMBER() OVER (PARTITION BY match_id ORDER BY innings DESC, seq DESC) AS from_end,
  h.won, h.w1 FROM scored s JOIN (SELECT match_id, (COUNT(DISTINCT innings) = 2 AND match_id % 17 <> 0 AND t1 <> t2) AS won, t1 > t2 AS w1 FROM (
   SELECT match_id, innings, SUM(CASE WHEN innings = 1 THEN runs_total ELSE 0 END) OVER m AS t1, SUM(CASE WHEN innings = 2 THEN runs_total ELSE 0 END) OVER m AS t2
   FROM cut WINDOW m AS (PARTITION BY match_id)) GROUP BY match_id, t1, t2) h USING (match_id)) WHERE from_end > 1 OR won""",
           "cut", extra=SCORED | {
               "fs2": "SELECT 120 AS u, 0 AS w, 0 AS r", "start_p": FIRST.replace("first_states", "fs2")}))
def chart_series(t):
    c = F.col
    rows = t.limited
    matches = match_ops.match_rows(t.headers(rows=rows), match_ops.innings_totals(rows))
    curve = state.timeline(rows).join(
        _scored(t).select("match_id", "innings", "seq", "p"), ["match_id", "innings", "seq"])
    out = winmodel.chart_series(curve, matches, given_model(t))
    return out.select("match_id", "innings", "seq", billion(c("x")).alias("x_e9"),
                      billion(c("p")).alias("p_e9"), "score", "over_end")


CHASE_P = f"""SELECT u, w, target - r AS need, NOT batting_first_won AS won, {chase_sql('u', 'w', '(target - r)')} AS p FROM trace
 WHERE innings = 2 AND batting_first_won IS NOT NULL AND target - r > 0 AND w < 10 AND u > 0"""
BASE = "SELECT AVG(CASE WHEN w1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS base FROM (SELECT match_id, BOOL_OR(batting_first_won) AS w1 FROM trace WHERE batting_first_won IS NOT NULL GROUP BY 1)"
MILLION = "CAST(FLOOR(({}) * 1e6 + 0.5) AS BIGINT)".format


def _chase_predictions(t):
    c = F.col
    traces = materialise(_traces(t), "traces")
    base = winmodel.base_rates(traces)
    return winmodel.chase_counts(traces).join(
        F.broadcast(given_model(t).drop("max_balls")), "format_key").join(
        F.broadcast(base), "format_key").select(
        "format_key", winmodel.chase_win(c("u"), c("w"), c("need")).alias("p"),
        F.when(c("won"), 1.0).otherwise(0.0).alias("y"), (F.lit(1.0) - c("base_first")).alias("base"), "n")


@query(sql(f"""SELECT 't20i-m' AS format_key, COUNT(*) AS states, {MILLION('SUM((p - y) * (p - y)) / COUNT(*)')} AS brier_e6,
 {MILLION('SUM((b - y) * (b - y)) / COUNT(*)')} AS baseline_e6, {MILLION('1 - SUM((p - y) * (p - y)) / SUM((b - y) * (b - y))')} AS skill_e6,
 {MILLION('SUM(-(y * LN(p) + (1 - y) * LN(1 - p))) / COUNT(*)')} AS log_loss_e6
FROM (SELECT LEAST(GREATEST(p, 1e-6), 1 - 1e-6) AS p, CASE WHEN won THEN {D(1)} ELSE {D(0)} END AS y, 1 - (SELECT base FROM base) AS b FROM cp)
HAVING COUNT(*) > 0""", "trace", extra={"cp": CHASE_P, "base": BASE}))
def chase_scores(t):
    """Brier, skill and log loss of a given model on every chase state."""
    out = winmodel.scores(_chase_predictions(t), ("format_key",))
    whole = lambda k, n: F.floor(F.col(k) * F.lit(1e6) + F.lit(0.5)).alias(f"{n}_e6")
    return out.select("format_key", "states", whole("brier", "brier"),
                      whole("baseline_brier", "baseline"), whole("skill", "skill"),
                      whole("log_loss", "log_loss"))


@query(sql(f"""SELECT CAST(LEAST(FLOOR(p * 10), 9) AS BIGINT) AS bin, COUNT(*) AS states, {MILLION('SUM(p) / COUNT(*)')} AS predicted_e6, {MILLION('SUM(y) / COUNT(*)')} AS observed_e6
FROM (SELECT LEAST(GREATEST(p, 1e-6), 1 - 1e-6) AS p, CASE WHEN won THEN {D(1)} ELSE {D(0)} END AS y FROM cp) GROUP BY 1""", "trace", extra={"cp": CHASE_P}))
def chase_calibration(t):
    out = winmodel.calibration(_chase_predictions(t), ("format_key",))
    whole = lambda k: F.floor(F.col(k) * F.lit(1e6) + F.lit(0.5)).alias(f"{k}_e6")
    return out.select("bin", "states", whole("predicted"), whole("observed"))


PAR = f"""SELECT venue_key, n AS matches, avg_e AS average_first_innings, CAST(ROUND_EVEN(150 + (avg_e - gmean) * n / (n + {D(8)}), 0) AS BIGINT) AS venue_par FROM (
 SELECT venue_key, COUNT(*) AS n, CAST(SUM(first_innings_total) AS BIGINT) / COUNT(*) AS avg_e,
  CAST(SUM(SUM(first_innings_total)) OVER () AS BIGINT) / CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS gmean
 FROM m WHERE first_innings_total IS NOT NULL GROUP BY 1) WHERE n >= 5"""


@query(sql(PAR, "m"))
def venue_pars(t):
    from overstats.catalog.matches import match_rows
    par = t.spark.createDataFrame([("t20i-m", 150)], "format_key string, par int")
    return winmodel.venue_pars(match_rows(t, False), par).drop("format_key")


@query(sql(f"""SELECT match_id, venue_key, venue, pars.venue_key AS par_key, venue_par, first_innings_total,
 CASE WHEN first_innings_total = venue_par THEN 'level with par' WHEN first_innings_total > venue_par THEN CAST(first_innings_total - venue_par AS VARCHAR) || ' above par'
  WHEN first_innings_total < venue_par THEN CAST(venue_par - first_innings_total AS VARCHAR) || ' below par' END AS versus
FROM m LEFT JOIN ({PAR}) pars USING (venue_key)""".replace("pars.venue_key AS par_key", "CASE WHEN venue_par IS NOT NULL THEN venue_key END AS par_key"), "m"))
def totals_against_par(t):
    from overstats.catalog.matches import match_rows
    c = F.col
    par = t.spark.createDataFrame([("t20i-m", 150)], "format_key string, par int")
    rows = materialise(match_rows(t, False), "matches")
    out = winmodel.with_venue_par(rows, winmodel.venue_pars(rows, par))
    versus = F.when(c("first_innings_total").isNotNull() & c("venue_par").isNotNull(),
                    winmodel.versus_par(c("first_innings_total"), c("venue_par")))
    return out.select("match_id", "venue_key", "venue", "par_key", "venue_par",
                      "first_innings_total", versus.alias("versus"))


@query()
def win_models(t):
    """Fitted, validated models with their holdout scores."""
    built = winmodel.build_models(materialise(_traces(t), "traces"), holdout="2020-01-01")
    c = F.col
    return built["models"].join(built["scores"].where("part = 'chase'"), "format_key").select(
        "format_key", "matches", "train_matches", "test_matches", "half_life", "par", "theta",
        "states", "brier", "baseline_brier", (c("brier") < 1).alias("is_probability"))


DISPERSED = RESOURCES | {
    "disp": """SELECT w, COALESCE(LAST_VALUE(d IGNORE NULLS) OVER (ORDER BY w), 1) AS d FROM (
      SELECT v.w, CASE WHEN den > 0 THEN num / den END AS d FROM (SELECT DISTINCT w FROM res) v LEFT JOIN (
       SELECT m.w, SUM(syy - n * y * y) AS num, SUM(n * resource) AS den FROM mom m JOIN res USING (w, u) GROUP BY 1) q ON q.w = v.w)""",
}


def _chase(u: str, w: str, need: str, res: str) -> str:
    x, f = f"LN({need} / GREATEST({res}, {D(0.5)}))", f"({u} / {D(120)})"
    z = f"({D(THETA[0])} + {D(THETA[1])} * {x} + {D(THETA[2])} * {x} * {f} + {D(THETA[3])} * {f} + {D(THETA[4])} * {x} * {w} / {D(10)})"
    return f"{D(1)} / ({D(1)} + EXP(-{z}))"


TABLED = DISPERSED | {
    "fiw": f"SELECT n AS t, {D(1)} - {_chase('120', '0', '(n + 1)', 'resource')} AS p FROM (SELECT UNNEST(GENERATE_SERIES(0, 600)) AS n), (SELECT resource FROM res WHERE u = 120 AND w = 0)",
}


def _half_fitted(t):
    """Resources and dispersions of the matches, with given chase weights: all that SQL can work out too."""
    weighted = materialise(winmodel.weighted_moments(winmodel.first_innings_moments(_traces(t))), "moments")
    table = materialise(winmodel.resource_table(winmodel.fit_curves(weighted)), "resources")
    theta = {(r.format_key, r.candidate): THETA for r in table.select(*winmodel.MODEL).distinct().collect()}
    return winmodel.model_table(table, winmodel.dispersions(weighted, table), theta)


@query(sql(f"SELECT CAST(t AS BIGINT) AS total, {BILLION('p')} AS p_e9 FROM fiw", "trace", extra=TABLED))
def first_innings_table(t):
    """P(side batting first wins) for every total, from fitted resources."""
    return _half_fitted(t).select(F.posexplode("first_innings_win").alias("total", "p")).select("total", billion(F.col("p")).alias("p_e9"))


@query(sql(f"""SELECT 't20i-m' AS format_key, CAST(probe AS BIGINT) AS probe, CAST(u AS BIGINT) AS balls_left, CAST(w AS BIGINT) AS wickets, CAST(r AS BIGINT) AS runs, CAST(need AS BIGINT) AS need,
 {MILLION('chase')} AS chase_e6, {MILLION('CASE WHEN var <= 0.25 THEN (SELECT p FROM fiw WHERE t = LEAST(ROUND_EVEN(mean, 0), 600)) ELSE integ END')} AS first_e6,
 {MILLION('mean')} AS projected_e6, {MILLION('GREATEST(r, mean - 1.2816e0 * SQRT(var))')} AS low_e6, {MILLION('mean + 1.2816e0 * SQRT(var)')} AS high_e6
FROM (SELECT s.*, {_chase('u', 'w', 'need', 'resource')} AS chase,
  (SELECT SUM(EXP({D(-0.5)} * POW((t - mean) / SQRT(var), 2)) * p) / SUM(EXP({D(-0.5)} * POW((t - mean) / SQRT(var), 2)))
   FROM fiw WHERE t BETWEEN GREATEST(r, TRUNC(mean - 4 * SQRT(var))) AND LEAST(600, TRUNC(mean + 4 * SQRT(var)) + 1)) AS integ
 FROM (SELECT g.*, resource, r + resource AS mean, d * resource AS var FROM golden g JOIN res USING (w, u) JOIN disp USING (w)) s)""", "trace", extra=TABLED | {
    "golden": f"""SELECT probe, u, w, CAST(TRUNC((120 - u) * ({D(0.9)} + (probe % 5) * {D(0.12)})) AS INT) AS r, 1 + (probe * 13) % 108 AS need
      FROM (SELECT probe, CAST(TRUNC(120 * ((probe * 37) % 100) / {D(100)}) AS INT) + 1 AS u, (probe * 7) % 10 AS w FROM (SELECT UNNEST(GENERATE_SERIES(0, 59)) AS probe))"""}))
def golden_probes(t):
    """Probes of a model whose resources are fitted on all usable matches."""
    c = F.col
    whole = lambda k, n: F.floor(c(k) * F.lit(1e6) + F.lit(0.5)).alias(f"{n}_e6")
    return winmodel.golden_states(_half_fitted(t)).select(
        "format_key", "probe", "balls_left", "wickets", "runs", "need", whole("chase", "chase"), whole("batting_first", "first"),
        whole("projected", "projected"), whole("projected_low", "low"), whole("projected_high", "high"))


BINNED = RESOURCES | {
    "binned": f"""SELECT COUNT(*) AS trials, COUNT(CASE WHEN NOT batting_first_won THEN 1 END) AS wins, AVG(x) AS x1, AVG(x * u / {D(120)}) AS x2, AVG(u / {D(120)}) AS x3, AVG(x * w / {D(10)}) AS x4
      FROM (SELECT *, LN((target - r) / GREATEST(resource, CAST(0.5 AS DOUBLE))) AS x FROM trace t JOIN res USING (w, u)
       WHERE innings = 2 AND batting_first_won IS NOT NULL AND target - r > 0 AND w < 10 AND u > 0) GROUP BY u // 6, w, CAST(ROUND_EVEN(x / CAST(0.05 AS DOUBLE), 0) AS BIGINT)""",
}


@query(sql("""SELECT CAST(i AS BIGINT) AS feature, CAST(FLOOR(moment * 1e3 + 0.5) AS BIGINT) AS moment_e3, trials FROM (
 SELECT i, SUM(wins * list_extract([1, x1, x2, x3, x4], i + 1)) AS moment, CAST(SUM(trials) AS BIGINT) AS trials
 FROM binned, (SELECT UNNEST(GENERATE_SERIES(0, 4)) AS i) GROUP BY 1)""", "trace", extra=BINNED))
def fit_gradients(t):
    """Proof of the fit: the penalised loss is convex, and its gradient is zero where what the weights expect of each
    feature, with the ridge's pull, is what was seen. Here what they expect; the SQL adds up what was seen."""
    c = F.col
    traces = materialise(_traces(t), "traces")
    weighted = materialise(winmodel.weighted_moments(winmodel.first_innings_moments(traces)), "moments")
    table = winmodel.resource_table(winmodel.fit_curves(weighted))
    bins = materialise(winmodel.feature_bins(winmodel.chase_counts(traces), table), "bins")
    theta = winmodel.fit_logistic(bins)
    expected = winmodel.expected_moments(bins, theta)
    return expected.select("feature", F.floor(c("moment") * F.lit(1e3) + F.lit(0.5)).alias("moment_e3"), c("trials").cast("bigint").alias("trials"))


@query(sql(f"""SELECT format_key, COUNT(*) AS matches, {n_if('batting_first_won')} AS won_first, {n_if('batting_first_won IS NULL')} AS tied
FROM (SELECT DISTINCT match_id, format_key, batting_first_won FROM trace) GROUP BY 1""", "trace"))
def usable_matches(t):
    c = F.col
    return _traces(t).select("match_id", "format_key", "batting_first_won").distinct().groupBy(
        "format_key").agg(F.count(F.lit(1)).alias("matches"),
                          F.count(F.when(c("batting_first_won"), 1)).alias("won_first"),
                          F.count(F.when(c("batting_first_won").isNull(), 1)).alias("tied"))
