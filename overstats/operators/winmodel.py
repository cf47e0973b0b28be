"""Win probability: ball states, resource tables, chase regression, scoring.

The corpus is read once into two tables of counted states whose size is
bounded by the game (balls left x wickets x runs x dates), and every fit,
candidate and validation works on those. Formats and half-life candidates are
fitted side by side: each Newton step is one aggregation over all of them,
and only 20 sums per model reach the driver for the 5x5 solve.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from overstats import config as C
from overstats.functions import flags, rates
from overstats.operators.matches import balls_available
from overstats.session import materialise

MODEL = ("format_key", "candidate")


# ---------------------------------------------------------------------------
# States
# ---------------------------------------------------------------------------
def usable_matches(matches: DataFrame, totals: DataFrame) -> DataFrame:
    """Full-length limited-overs matches played to a finish."""
    c = F.col
    overs = F.floor(balls_available(c("fmt")) / F.lit(6))
    second = totals.where(c("innings") == 2).select("match_id", "target_overs")
    return matches.join(second, "match_id").where(
        c("fmt").isin(*C.LIMITED_FORMATS)
        & (c("scheduled_overs").isNull() | (c("scheduled_overs") == overs))
        & c("method").isNull()
        & (c("winner").isNotNull() | (c("result_type") == "tie"))
        & (c("target_overs").isNull() | (c("target_overs") == overs))
    ).select("match_id", "winner", "batting_first")


def traces(deliveries: DataFrame, usable: DataFrame) -> DataFrame:
    """State before each legal ball: balls left, wickets down, runs.

    ``batting_first_won`` is null for a tie. Matches where either innings has
    no legal ball are left out. Innings are counted as played.
    """
    c = F.col
    order = Window.partitionBy("match_id", "innings").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    match = Window.partitionBy("match_id")
    played = c("played_no")
    zero = F.lit(0).cast("bigint")
    rows = deliveries.where((played <= 2) & c("fmt").isin(*C.LIMITED_FORMATS)).withColumns(
        {
            "legal_before": F.coalesce(
                F.sum(F.when(c("is_legal"), 1).otherwise(0)).over(before), zero),
            "wickets_before": F.coalesce(F.sum("team_wickets").over(before), zero),
            "score_before": F.coalesce(F.sum("runs_total").over(before), zero),
            "first_total": F.coalesce(
                F.sum(F.when(played == 1, c("runs_total"))).over(match), zero),
            "_w1": F.sum(F.when(played == 1, c("team_wickets"))).over(match),
            "_b1": F.count(F.when((played == 1) & c("is_legal"), 1)).over(match),
            "_b2": F.count(F.when((played == 2) & c("is_legal"), 1)).over(match),
            "max_balls": balls_available(c("fmt")),
        }
    )
    states = rows.where(c("is_legal") & (c("_b1") > 0) & (c("_b2") > 0)).join(usable, "match_id")
    return states.select(
        "match_id", "format_key", "date", "venue_key", played.alias("innings"),
        c("legal_before").alias("state_no"),
        (c("max_balls") - c("legal_before")).alias("u"), c("wickets_before").alias("w"),
        c("score_before").alias("r"), "first_total",
        ((c("_w1") >= 10) | (c("_b1") >= c("max_balls"))).alias("first_complete"),
        F.when(c("target") > 0, c("target")).otherwise(c("first_total") + 1).alias("target"),
        F.when(c("winner").isNotNull(), c("winner") == c("batting_first"))
        .alias("batting_first_won"),
        "max_balls",
    )


def first_innings_moments(states: DataFrame) -> DataFrame:
    """Counts, sums and squares of runs still to come, per date and state."""
    c = F.col
    y = (c("first_total") - c("r")).cast("double")
    return states.where((c("innings") == 1) & c("first_complete")).groupBy(
        "format_key", "max_balls", "date", "w", "u"
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"))


def chase_counts(states: DataFrame) -> DataFrame:
    """Decided chase states, counted by date, state, need and outcome."""
    c = F.col
    need = c("target") - c("r")
    return states.where(
        (c("innings") == 2) & c("batting_first_won").isNotNull() & (need > 0) & (c("w") < 10)
        & (c("u") > 0)
    ).groupBy(
        "format_key", "max_balls", "date", "w", "u", need.alias("need"),
        (~c("batting_first_won")).alias("won"),
    ).agg(F.count(F.lit(1)).alias("n"))


def first_innings_counts(states: DataFrame, strides: int = 12) -> DataFrame:
    """First-innings states by outcome, with their place in the innings."""
    c = F.col
    return states.where((c("innings") == 1) & c("batting_first_won").isNotNull()).groupBy(
        "format_key", "date", "w", "u", "r", c("batting_first_won").alias("won"),
        (c("state_no") % strides).alias("stride"),
    ).agg(F.count(F.lit(1)).alias("n"))


def sampled(rows: DataFrame, stride: int, number: str = "state_no") -> DataFrame:
    """Every ``stride``-th state of an innings."""
    return rows.where(F.col(number) % stride == 0)


# ---------------------------------------------------------------------------
# Resources
# ---------------------------------------------------------------------------
def with_candidates(rows: DataFrame, half_lives) -> DataFrame:
    """One copy of the counted states per half-life, weighted by recency."""
    options = F.array(*[
        F.struct(F.lit(i).alias("candidate"),
                 F.lit(h).cast("double").alias("half_life"))
        for i, h in enumerate(half_lives)
    ])
    newest = rows.groupBy("format_key").agg(F.max("date").alias("_newest"))
    weight = rates.recency_weight(F.col("date"), F.col("_newest"), F.col("half_life"))
    return rows.join(newest, "format_key").select(
        "*", F.inline(options)
    ).withColumn("weight", weight * F.col("n")).drop("_newest")


def weighted_moments(moments: DataFrame, half_lives=(None,)) -> DataFrame:
    """Weighted n, sum and sum of squares per model, wickets and balls left."""
    c = F.col
    per = c("weight") / c("n")
    return with_candidates(moments, half_lives).groupBy(*MODEL, "max_balls", "w", "u").agg(
        F.sum("weight").alias("n"), F.sum(per * c("sy")).alias("sy"),
        F.sum(per * c("syy")).alias("syy"),
    )


GRID = 400


def fit_curves(weighted: DataFrame) -> DataFrame:
    """Z(1 - exp(-b u)) per model and wickets, by least squares on a b grid.

    For each of the 400 candidate b the best Z has a closed form; its squared
    residuals choose b. Points are bounded by the game (wickets x balls x grid).
    Fewer than three states at a wicket count inherit the previous curve.
    """
    c = F.col
    exponent = F.lit(-4.0) + F.lit(3.0) * c("i") / F.lit(float(GRID - 1))
    points = weighted.where(c("n") > 1e-9).select(
        *MODEL, "max_balls", "w", "u", "n", (c("sy") / c("n")).alias("y"),
        F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("i"),
    ).withColumn("b", F.pow(F.lit(10.0), exponent))
    g = F.lit(1.0) - F.exp(-c("b") * c("u"))
    option = Window.partitionBy(*MODEL, "w", "i")
    points = points.withColumn("g", g).withColumns({
        "den": F.sum(c("n") * c("g") * c("g")).over(option), "z": F.sum(c("n") * c("y") * c("g")).over(option) / F.sum(c("n") * c("g") * c("g")).over(option)})
    # Squared residuals are summed with Z known: a difference of large sums would lose the digits that tell options apart.
    residual = c("y") - c("z") * c("g")
    best = points.where(c("den") > 0).groupBy(*MODEL, "max_balls", "w", "i").agg(
        F.count(F.lit(1)).alias("rows"), F.max("b").alias("b"), F.max("z").alias("z"),
        F.sum(c("n") * residual * residual).alias("err"),
    ).groupBy(*MODEL, "max_balls", "w").agg(
        F.max("rows").alias("rows"),
        F.min_by(F.struct("z", "b"), F.struct("err", "i")).alias("_best"),
    ).where(c("rows") >= 3)
    all_w = weighted.select(*MODEL, "max_balls").distinct().withColumn(
        "w", F.explode(F.sequence(F.lit(0), F.lit(9)))
    )
    order = Window.partitionBy(*MODEL).orderBy("w")
    joined = all_w.join(
        best.select(*MODEL, c("w").cast("int").alias("w"), "_best"), [*MODEL, "w"], "left"
    )
    kept = F.last("_best", ignorenulls=True).over(order)
    return joined.withColumn("_best", kept).select(
        *MODEL, "max_balls", "w", F.coalesce("_best.z", F.lit(0.0)).alias("z"),
        F.coalesce("_best.b", F.lit(0.01)).alias("b"),
    )


def resource_table(curves: DataFrame) -> DataFrame:
    """Expected further runs per wickets and balls left; never more for a wicket."""
    c = F.col
    rows = curves.withColumn("u", F.explode(F.sequence(F.lit(0), c("max_balls").cast("int"))))
    capped = Window.partitionBy(*MODEL, "u").orderBy("w").rowsBetween(
        Window.unboundedPreceding, 0
    )
    value = c("z") * (F.lit(1.0) - F.exp(-c("b") * c("u")))
    return rows.withColumn("raw", value).select(
        *MODEL, "max_balls", "w", "u", F.min("raw").over(capped).alias("resource")
    )


def dispersions(weighted: DataFrame, table: DataFrame) -> DataFrame:
    """Variance over mean of further runs, per wickets down."""
    c = F.col
    mean = c("sy") / c("n")
    held = weighted.where(c("n") > 1e-9).join(
        table.select(*MODEL, "w", "u", "resource"), [*MODEL, "w", "u"]
    ).groupBy(*MODEL, "w").agg(
        F.sum(c("syy") - c("n") * mean * mean).alias("num"),
        F.sum(c("n") * c("resource")).alias("den"),
    )
    order = Window.partitionBy(*MODEL).orderBy("w")
    ratio = F.when(c("den") > 0, c("num") / c("den"))
    all_w = table.select(*MODEL, "w").distinct()
    return all_w.join(held, [*MODEL, "w"], "left").withColumn("_d", ratio).select(
        *MODEL, "w",
        F.coalesce(F.last("_d", ignorenulls=True).over(order), F.lit(1.0)).alias("dispersion"),
    )


# ---------------------------------------------------------------------------
# Chase regression
# ---------------------------------------------------------------------------
def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).otherwise(
        F.exp(z) / (F.lit(1.0) + F.exp(z))
    )


def chase_features(u: Column, w: Column, need: Column, resource: Column,
                   max_balls: Column) -> list[Column]:
    """1, x, x f, f, x w / 10 with x the log share of resources needed."""
    x = F.log(need / F.greatest(resource, F.lit(0.5)))
    f = u / max_balls
    return [F.lit(1.0), x, x * f, f, x * w / F.lit(10.0)]


def feature_bins(chases: DataFrame, table: DataFrame, half_lives=(None,)) -> DataFrame:
    """Weighted mean features and wins per (balls // 6, wickets, x / 0.05) bin."""
    c = F.col
    rows = with_candidates(chases, half_lives).join(
        table.select(*MODEL, "w", "u", "resource"), [*MODEL, "w", "u"]
    )
    xs = chase_features(c("u"), c("w"), c("need"), c("resource"), c("max_balls"))
    rows = rows.withColumns({f"x{i}": x for i, x in enumerate(xs)})
    return rows.groupBy(
        *MODEL, F.floor(c("u") / F.lit(C.BALL_BIN)).alias("u_bin"), "w",
        F.bround(c("x1") / F.lit(C.X_BIN)).cast("bigint").alias("x_bin"),
    ).agg(
        *[(F.sum(c("weight") * c(f"x{i}")) / F.sum("weight")).alias(f"x{i}") for i in range(5)],
        F.sum(F.when(c("won"), c("weight")).otherwise(0.0)).alias("wins"),
        F.sum("weight").alias("trials"),
    ).where(c("trials") > 1e-9)


def fit_logistic(bins: DataFrame, iterations: int = 50, tolerance: float = 1e-8) -> dict:
    """Newton's method with a ridge on every weight, all models in step.

    Each step is one aggregation to 5 + 15 sums per model; the 5x5 solves
    happen on the driver. Returns {(format_key, candidate): weights}.
    """
    c = F.col
    bins = materialise(bins, "chase-bins")
    keys = [(r["format_key"], r["candidate"]) for r in bins.select(*MODEL).distinct().collect()]
    theta = {k: np.zeros(5) for k in keys}
    active = set(keys)
    spark = bins.sparkSession
    pairs = [(i, j) for i in range(5) for j in range(i, 5)]
    for _ in range(iterations):
        if not active:
            break
        # Bounded by construction: one row per model still being fitted.
        now = spark.createDataFrame(
            [(k[0], k[1], [float(v) for v in theta[k]]) for k in sorted(active)],
            "format_key string, candidate int, theta array<double>",
        )
        rows = bins.join(F.broadcast(now), list(MODEL))
        dot = sum((F.get("theta", F.lit(i)) * c(f"x{i}") for i in range(1, 5)),
                  F.get("theta", F.lit(0)) * c("x0"))
        rows = rows.withColumn("p", sigmoid(dot))
        gradient = c("wins") - c("trials") * c("p")
        curvature = c("trials") * c("p") * (F.lit(1.0) - c("p"))
        sums = rows.groupBy(*MODEL).agg(
            *[F.sum(gradient * c(f"x{i}")).alias(f"g{i}") for i in range(5)],
            *[F.sum(curvature * c(f"x{i}") * c(f"x{j}")).alias(f"h{i}{j}") for i, j in pairs],
        ).collect()
        for row in sums:
            key = (row["format_key"], row["candidate"])
            hess = np.eye(5) * C.RIDGE
            for i, j in pairs:
                hess[i, j] += row[f"h{i}{j}"]
                if i != j:
                    hess[j, i] += row[f"h{i}{j}"]
            grad = np.array([row[f"g{i}"] for i in range(5)]) - C.RIDGE * theta[key]
            step = np.linalg.solve(hess, grad)
            theta[key] = theta[key] + step
            if np.max(np.abs(step)) < tolerance:
                active.discard(key)
    return theta


def expected_moments(bins: DataFrame, theta: dict, ridge: float = C.RIDGE) -> DataFrame:
    """What fitted weights expect of each feature over all trials, with the ridge's pull: at the optimum the wins' own sums."""
    c = F.col
    rows = bins.sparkSession.createDataFrame(
        [(k[0], k[1], [float(v) for v in t]) for k, t in sorted(theta.items())], "format_key string, candidate int, theta array<double>")
    dot = sum((F.get("theta", F.lit(i)) * c(f"x{i}") for i in range(1, 5)), F.get("theta", F.lit(0)) * c("x0"))
    at = bins.join(rows, list(MODEL)).withColumn("expected", c("trials") * sigmoid(dot))
    sums = at.groupBy(*MODEL).agg(
        F.sum("trials").alias("trials"), F.first("theta").alias("theta"), *[F.sum(c("expected") * c(f"x{i}")).alias(f"_{i}") for i in range(5)])
    each = F.array(*[F.struct(F.lit(i).alias("feature"), (c(f"_{i}") + F.lit(ridge) * F.get("theta", F.lit(i))).alias("moment")) for i in range(5)])
    return sums.select(*MODEL, "trials", F.inline(each))


# ---------------------------------------------------------------------------
# The model as a table: one row per format and candidate
# ---------------------------------------------------------------------------
def model_table(table: DataFrame, spread: DataFrame, theta: dict,
                max_total: int = C.MAX_TOTAL, rounded: bool = False) -> DataFrame:
    """Everything scoring needs in one row per model.

    ``rounded`` keeps the digits a published model has, so that whoever loads
    it scores exactly alike. Everything is worked out in full digits and
    rounded once, at the end.
    """
    c = F.col
    curves = table.groupBy(*MODEL, "max_balls", "w").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("u", "resource"))),
                    lambda x: x["resource"]).alias("_row")
    ).groupBy(*MODEL, "max_balls").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("w", "_row"))),
                    lambda x: x["_row"]).alias("resources")
    )
    spreads = spread.groupBy(*MODEL).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("w", "dispersion"))),
                    lambda x: x["dispersion"]).alias("dispersion")
    )
    weights = table.sparkSession.createDataFrame(
        [(k[0], k[1], [float(v) for v in t]) for k, t in sorted(theta.items())],
        "format_key string, candidate int, theta array<double>",
    )
    model = curves.join(spreads, list(MODEL)).join(weights, list(MODEL))
    totals = F.sequence(F.lit(1), F.lit(max_total + 1))
    full = c("max_balls").cast("int")
    top = F.get(F.get("resources", F.lit(0)), full)

    def win(need: Column) -> Column:
        xs = chase_features(full, F.lit(0), need, top, full)
        dot = sum((F.get("theta", F.lit(i)) * xs[i] for i in range(1, 5)),
                  F.get("theta", F.lit(0)) * xs[0])
        return F.lit(1.0) - sigmoid(dot)

    model = model.withColumn("first_innings_win", F.transform(totals, win))
    if not rounded:
        return model
    digits = lambda name, n: F.transform(name, lambda x: F.round(x, n))
    return model.withColumns({
        "resources": F.transform("resources", lambda row: F.transform(row, lambda x: F.round(x, 3))),
        "dispersion": digits("dispersion", 4), "theta": digits("theta", 6),
        "first_innings_win": digits("first_innings_win", 5),
    })


def expected(u: Column, w: Column) -> Column:
    """Expected further runs; 0 when all out or out of balls."""
    at = F.least(u, F.col("max_balls")).cast("int")
    value = F.get(F.get("resources", w.cast("int")), at)
    return F.when((w >= 10) | (u <= 0), 0.0).otherwise(value)


def variance(u: Column, w: Column) -> Column:
    return F.when((w >= 10) | (u <= 0), 0.0).otherwise(
        F.get("dispersion", w.cast("int")) * expected(u, w)
    )


def chase_win(u: Column, w: Column, need: Column) -> Column:
    """P(chasing side wins) with ``need`` runs required."""
    xs = chase_features(u, w, need, expected(u, w), F.col("max_balls"))
    dot = sum((F.get("theta", F.lit(i)) * xs[i] for i in range(1, 5)),
              F.get("theta", F.lit(0)) * xs[0])
    return F.when(need <= 0, 1.0).when((w >= 10) | (u <= 0), 0.0).otherwise(sigmoid(dot))


def batting_first_win(u: Column, w: Column, runs: Column) -> Column:
    """P(side batting first wins), integrated over its final total."""
    mean = runs + expected(u, w)
    var = variance(u, w)
    sd = F.sqrt(var)
    top = F.size("first_innings_win") - 1
    at = lambda t: F.get("first_innings_win", t)
    at_mean = at(F.least(F.bround(mean).cast("int"), top))
    lo = F.greatest(runs.cast("int"), (mean - F.lit(4.0) * sd).cast("int"))
    hi = F.least(top, (mean + F.lit(4.0) * sd).cast("int") + 1)
    start = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("p"))

    def add(acc: Column, t: Column) -> Column:
        wt = F.exp(F.lit(-0.5) * F.pow((t - mean) / sd, 2))
        return F.struct((acc["w"] + wt).alias("w"), (acc["p"] + wt * at(t)).alias("p"))

    spread = F.aggregate(
        F.when((var > 0.25) & (lo <= hi), F.sequence(lo, hi)), start, add,
        lambda acc: F.when(acc["w"] > 0, acc["p"] / acc["w"]),
    )
    return F.when(var <= 0.25, at_mean).otherwise(F.coalesce(spread, at_mean))


def projection(u: Column, w: Column, runs: Column) -> dict[str, Column]:
    """Projected total with its 80% band."""
    mean = runs + expected(u, w)
    sd = F.sqrt(variance(u, w))
    return {
        "projected": mean,
        "projected_low": F.greatest(runs.cast("double"), mean - F.lit(C.BAND_80) * sd),
        "projected_high": mean + F.lit(C.BAND_80) * sd,
    }


def par_total() -> Column:
    """The first total with an even chance, from the published table."""
    spots = F.transform("first_innings_win", lambda p, i: F.when(p >= 0.5, i))
    return F.coalesce(
        F.array_min(F.filter(spots, lambda i: i.isNotNull())), F.size("first_innings_win") - 1
    )


def _win_row(mean: pd.Series, var: pd.Series, wins: pd.Series) -> pd.Series:
    """:func:`batting_first_win` for all runs so far, given mean and variance of the further ones."""
    out = []
    for further, spread, p in zip(mean, var, wins):
        p = np.asarray(p)
        top, runs = len(p) - 1, np.arange(len(p))
        at_mean = p[np.minimum(np.rint(runs + further).astype(int), top)]
        if spread > 0.25:
            sd = np.sqrt(spread)
            centre = (runs + further)[:, None]
            total = runs[:, None] + np.arange(int(further + 4 * sd) + 3)
            inside = (total >= np.trunc(centre - 4 * sd)) & (total <= np.minimum(top, np.trunc(centre + 4 * sd) + 1))
            weight = np.where(inside, np.exp(-0.5 * ((total - centre) / sd) ** 2), 0.0)
            sums = weight.sum(1)
            at_mean = np.where(sums > 0, (weight * p[np.minimum(total, top)]).sum(1) / np.where(sums > 0, sums, 1), at_mean)
        out.append(at_mean)
    return pd.Series(out)


def with_win_grid(model: DataFrame) -> DataFrame:
    """``model`` plus ``win_grid``: P(side batting first wins) of every first-innings state.

    Place (wickets, balls left, runs) holds what :func:`batting_first_win` gives, for 0 to 9 wickets, 0 to all balls and 0 to
    the largest total; further runs change nothing. The game bounds it: 6 MB for 120 balls, 15 MB for 300.
    """
    c = F.col
    partitions = int(model.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    states = model.withColumn("_w", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn(
        "_u", F.explode(F.sequence(F.lit(0), c("max_balls").cast("int")))).repartition(4 * partitions, "format_key", "_w", "_u")
    win_row = F.pandas_udf(_win_row, "array<double>")
    rows = states.select("format_key", "_w", "_u", win_row(expected(c("_u"), c("_w")), variance(c("_u"), c("_w")), c("first_innings_win")).alias("_row"))
    grid = rows.groupBy("format_key").agg(F.sort_array(F.collect_list(F.struct("_w", "_u", "_row"))).alias("_rows")).select(
        "format_key", F.flatten(F.transform("_rows", lambda x: x["_row"])).alias("win_grid"))
    return model.join(grid, "format_key")


def grid_win(u: Column, w: Column, runs: Column) -> Column:
    """:func:`batting_first_win`, looked up in ``win_grid``."""
    totals = F.size("first_innings_win")
    over = (w >= 10) | (u <= 0)
    wickets = F.when(over, 0).otherwise(w).cast("int")
    balls = F.when(over, 0).otherwise(F.least(u, F.col("max_balls"))).cast("int")
    total = F.greatest(F.lit(0), F.least(runs, totals - 1)).cast("int")
    return F.get("win_grid", (wickets * (F.col("max_balls").cast("int") + 1) + balls) * totals + total)


def score_states(states: DataFrame, model: DataFrame) -> DataFrame:
    """Add ``p``, P(side batting first wins), to replay states.

    First innings are looked up in the format's grid, chases are a formula, both in the row: states are not shuffled. The
    model, a row per format, goes to every task.
    """
    c = F.col
    cols = ["max_balls", "resources", "dispersion", "theta", "first_innings_win", "win_grid"]
    grids = materialise(with_win_grid(model.select("format_key", *cols[:-1])), "win-grid")
    if grids.groupBy("format_key").count().where("count > 1").head():
        raise ValueError("one model a format")
    states, taken = states.drop("p"), [x for x in cols if x in states.columns]
    kept = states.columns
    rows = states.withColumnsRenamed({x: f"_own_{x}" for x in taken}).join(F.broadcast(grids), "format_key", "left")
    need = F.coalesce("target", F.lit(0)) - c("runs")
    p = F.when(c("innings") == 1, grid_win(c("balls_left"), c("wickets"), c("runs"))).otherwise(
        F.lit(1.0) - chase_win(c("balls_left"), c("wickets"), need))
    return rows.select(*[c(f"_own_{x}" if x in taken else x).alias(x) for x in kept], F.when(c("theta").isNotNull(), p).alias("p"))


def chart_series(curve: DataFrame, matches: DataFrame, model: DataFrame) -> DataFrame:
    """Points of the win chart: a start point, every ball, the result last.

    ``curve`` holds timeline columns with ``p``. The last ball of the match
    shows the result when someone won, and is dropped otherwise.
    """
    c = F.col
    facts = matches.select("match_id", "winner", "batting_first", "result_type")
    per_over = model.select("format_key", (c("max_balls") / F.lit(6.0)).alias("_overs"))
    match = Window.partitionBy("match_id").orderBy(F.desc("innings"), F.desc("seq"))
    rows = curve.join(facts, "match_id").join(F.broadcast(per_over), "format_key").withColumn(
        "_from_end", F.row_number().over(match)
    )
    last = c("_from_end") == 1
    shown = rows.where(~last | (c("result_type") == "win")).select(
        "match_id", "innings", "seq", "label",
        ((c("innings") - 1) * c("_overs") + c("legal_balls") / F.lit(6.0)).alias("x"),
        F.when(last, F.when(c("winner") == c("batting_first"), 1.0).otherwise(0.0))
        .otherwise(c("p")).alias("p"),
        F.concat(c("score").cast("string"), F.lit("/"), c("wickets_down").cast("string"))
        .alias("score"),
        (c("is_legal") & (c("legal_balls") % 6 == 0)).alias("over_end"),
    )
    opening = curve.groupBy("match_id", "format_key").agg(
        F.min_by("penalty_pre", F.struct("innings", "seq")).alias("_pre")
    ).join(F.broadcast(model), "format_key").select(
        "match_id", F.lit(1).alias("innings"), F.lit(0).alias("seq"), F.lit("0.0").alias("label"),
        F.lit(0.0).alias("x"),
        batting_first_win(c("max_balls"), F.lit(0), c("_pre")).alias("p"),
        F.lit("Start").alias("score"), F.lit(True).alias("over_end"),
    )
    return opening.unionByName(shown)


# ---------------------------------------------------------------------------
# Scoring a model
# ---------------------------------------------------------------------------
def scores(predictions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Brier, baseline Brier, skill and log loss of weighted predictions.

    ``predictions`` has p, y (0/1), base (the constant forecast) and n.
    """
    c = F.col
    p = F.least(F.greatest(c("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = -(c("y") * F.log(p) + (F.lit(1.0) - c("y")) * F.log(F.lit(1.0) - p))
    sums = predictions.groupBy(*keys).agg(
        flags.total(c("n")).alias("states"),
        F.sum(c("n") * (p - c("y")) * (p - c("y"))).alias("_b"),
        F.sum(c("n") * (c("base") - c("y")) * (c("base") - c("y"))).alias("_bb"),
        F.sum(c("n") * loss).alias("_l"),
    )
    n = F.greatest(c("states"), F.lit(1))
    return sums.select(
        *keys, "states", (c("_b") / n).alias("brier"), (c("_bb") / n).alias("baseline_brier"),
        (F.lit(1.0) - c("_b") / F.greatest(c("_bb"), F.lit(1e-9))).alias("skill"),
        (c("_l") / n).alias("log_loss"),
    )


def calibration(predictions: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Mean prediction and outcome in ten probability bins."""
    c = F.col
    p = F.least(F.greatest(c("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return predictions.withColumn("p", p).groupBy(
        *keys, F.least(F.floor(c("p") * 10), F.lit(9)).cast("int").alias("bin")
    ).agg(
        flags.total(c("n")).alias("states"),
        (F.sum(c("n") * c("p")) / F.sum("n")).alias("predicted"),
        (F.sum(c("n") * c("y")) / F.sum("n")).alias("observed"),
    )


def base_rates(states: DataFrame) -> DataFrame:
    """Share of decided matches won by the side batting first, per format."""
    decided = states.where(F.col("batting_first_won").isNotNull()).select(
        "format_key", "match_id", "batting_first_won"
    ).distinct()
    return decided.groupBy("format_key").agg(
        F.avg(F.when(F.col("batting_first_won"), 1.0).otherwise(0.0)).alias("base_first")
    )


def predictions(chases: DataFrame, firsts: DataFrame, model: DataFrame, base: DataFrame,
                stride: int = 6) -> DataFrame:
    """Held-out states with the model's probability, outcome and baseline."""
    c = F.col
    base = F.broadcast(base)
    # The model is one row per format and candidate, so it is broadcast.
    chase = chases.join(F.broadcast(model.drop("max_balls")), "format_key").join(
        base, "format_key"
    ).select(
        *MODEL, F.lit("chase").alias("part"), chase_win(c("u"), c("w"), c("need")).alias("p"),
        F.when(c("won"), 1.0).otherwise(0.0).alias("y"),
        (F.lit(1.0) - c("base_first")).alias("base"), "n",
    )
    first = sampled(firsts, stride, "stride").join(F.broadcast(model), "format_key").join(
        base, "format_key"
    ).select(
        *MODEL, F.lit("first").alias("part"),
        batting_first_win(c("u"), c("w"), c("r")).alias("p"),
        F.when(c("won"), 1.0).otherwise(0.0).alias("y"), c("base_first").alias("base"), "n",
    )
    return chase.unionByName(first)


# ---------------------------------------------------------------------------
# Fitting, selection, the whole build
# ---------------------------------------------------------------------------
def fit(moments: DataFrame, chases: DataFrame, half_lives=(None,),
        rounded: bool = False) -> DataFrame:
    """Models for every format and half-life candidate."""
    weighted = materialise(weighted_moments(moments, half_lives), "moments")
    table = materialise(resource_table(fit_curves(weighted)), "resources")
    theta = fit_logistic(feature_bins(chases, table, half_lives))
    return materialise(
        model_table(table, dispersions(weighted, table), theta, rounded=rounded), "model"
    )


def half_life_scores(moments: DataFrame, chases: DataFrame, firsts: DataFrame, base: DataFrame, match_dates: DataFrame,
                     holdout: str, years: int = 3, half_lives=C.HALF_LIVES) -> DataFrame:
    """(format_key, candidate, half_life, brier) of every half-life, fitted before and scored on the years before the holdout.

    ``brier`` adds the rounded scores of both innings. Formats with fewer than 50 matches to fit or 20 to validate have none.
    """
    c = F.col
    split = f"{int(holdout[:4]) - years:04d}{holdout[4:]}"
    early, late = c("date") < split, (c("date") >= split) & (c("date") < holdout)
    spark = moments.sparkSession
    sizes = match_dates.groupBy("format_key").agg(
        flags.count_if(early).alias("fit"), flags.count_if(late).alias("val")
    ).where("fit >= 50 AND val >= 20")
    formats = [r["format_key"] for r in sizes.collect()]  # formats are a handful
    schema = "format_key string, candidate int, half_life double, brier double"
    if not formats:
        return spark.createDataFrame([], schema)
    chosen = c("format_key").isin(*formats)
    model = fit(moments.where(early & chosen), chases.where(early & chosen), half_lives)
    scored = scores(
        predictions(chases.where(late & chosen), firsts.where(late & chosen), model, base, 12),
        (*MODEL, "part"),
    ).groupBy(*MODEL).agg(F.round(F.sum(F.round("brier", 4)), 4).alias("brier"))
    options = spark.createDataFrame([(k, None if h is None else float(h)) for k, h in enumerate(half_lives)], "candidate int, half_life double")
    return scored.join(options, "candidate").select("format_key", "candidate", "half_life", "brier")


def choose_half_lives(moments: DataFrame, chases: DataFrame, firsts: DataFrame,
                      base: DataFrame, match_dates: DataFrame, holdout: str,
                      years: int = 3, half_lives=C.HALF_LIVES) -> dict[str, float | None]:
    """Half-life per format with the best of :func:`half_life_scores`, the first of equal ones."""
    best = half_life_scores(moments, chases, firsts, base, match_dates, holdout, years, half_lives).groupBy("format_key").agg(
        F.min_by("half_life", F.struct("brier", "candidate")).alias("half_life"))
    return {r["format_key"]: r["half_life"] for r in best.collect()}


def build_models(states: DataFrame, holdout: str = C.HOLDOUT_FROM,
                 min_matches: int = C.MIN_MODEL_MATCHES) -> dict[str, DataFrame]:
    """Fit, validate and publish a model for every format with enough matches.

    Returns ``models`` (fitted on everything, published digits), ``scores``
    and ``calibration`` on the holdout, and ``half_lives``.
    """
    c = F.col
    spark = states.sparkSession
    dates = states.select("format_key", "match_id", "date").distinct()
    enough = [
        r["format_key"] for r in dates.groupBy("format_key").count()
        .where(c("count") >= min_matches).collect()
    ]
    states = states.where(c("format_key").isin(*enough)) if enough else states.where("false")
    moments = materialise(first_innings_moments(states), "first-moments")
    chases = materialise(chase_counts(states), "chase-counts")
    firsts = materialise(first_innings_counts(states), "first-counts")
    train = c("date") < holdout
    base = materialise(base_rates(states.where(train)), "base-rates")
    half_lives = choose_half_lives(moments, chases, firsts, base, dates, holdout)
    # One pass fits every format: only the candidate each format chose is kept.
    options = tuple(dict.fromkeys(half_lives.get(fk) for fk in enough)) or (None,)
    picked = spark.createDataFrame(
        [(fk, options.index(half_lives.get(fk)), half_lives.get(fk)) for fk in enough],
        "format_key string, candidate int, half_life double",
    )
    keep = F.broadcast(picked)
    validated = fit(moments.where(train), chases.where(train), options).join(keep, list(MODEL))
    held = predictions(chases.where(~train), firsts.where(~train), validated.drop("half_life"), base)
    held = materialise(held, "holdout")
    final = fit(moments, chases, options, rounded=True).join(keep, list(MODEL))
    counts = dates.groupBy("format_key").agg(
        F.count(F.lit(1)).alias("matches"), flags.count_if(train).alias("train_matches"),
        flags.count_if(~train).alias("test_matches"),
    )
    return {
        "models": final.join(counts, "format_key").withColumn("par", par_total()),
        "scores": scores(held, ("format_key", "part")),
        "calibration": calibration(held, ("format_key", "part")),
        "half_lives": picked.select("format_key", "half_life"),
    }


# ---------------------------------------------------------------------------
# Par and probes
# ---------------------------------------------------------------------------
def venue_pars(matches: DataFrame, par: DataFrame, min_matches: int = C.VENUE_PAR_MATCHES,
               prior: float = C.VENUE_PAR_PRIOR) -> DataFrame:
    """Ground par: the format's par shifted by how the ground scores, shrunk.

    ``par`` has (format_key, par). Grounds are folded before the comparison.
    """
    c = F.col
    rows = matches.where(
        c("first_innings_total").isNotNull() & (F.coalesce("venue_key", F.lit("")) != "")
    )
    grounds = rows.groupBy("format_key", "venue_key").agg(
        F.count(F.lit(1)).alias("matches"),
        flags.total(c("first_innings_total")).alias("_runs"),
    )
    every = grounds.groupBy("format_key").agg(
        (F.sum("_runs") / F.sum("matches")).alias("_mean")
    )
    average = c("_runs") / c("matches")
    shift = (average - c("_mean")) * c("matches") / (c("matches") + F.lit(prior))
    return grounds.join(every, "format_key").join(par, "format_key").where(
        c("matches") >= min_matches
    ).select(
        "format_key", "venue_key", "matches", average.alias("average_first_innings"),
        F.bround(c("par") + shift).cast("bigint").alias("venue_par"),
    )


def with_venue_par(matches: DataFrame, pars: DataFrame) -> DataFrame:
    """A match's ground par: by key, by full name, by name before the comma."""
    c = F.col
    out = matches
    tries = (("venue_key", "_p1"), ("venue", "_p2"), ("_short", "_p3"))
    out = out.withColumn("_short", F.trim(F.substring_index("venue", ",", 1)))
    for column, name in tries:
        side = pars.select(
            c("format_key").alias("_fk"), c("venue_key").alias("_key"),
            F.struct("venue_key", "venue_par").alias(name),
        )
        out = out.join(
            side, (c("format_key") == c("_fk")) & (c(column) == c("_key")), "left"
        ).drop("_fk", "_key")
    return out.withColumn("_par", F.coalesce("_p1", "_p2", "_p3")).withColumns(
        {"par_key": c("_par.venue_key"), "venue_par": c("_par.venue_par")}
    ).drop("_short", "_p1", "_p2", "_p3", "_par")


def versus_par(total: Column, par: Column) -> Column:
    whole = F.round(total).cast("bigint")
    return F.when(whole == par, "level with par").otherwise(
        F.concat(F.abs(whole - par).cast("string"),
                 F.when(whole > par, " above").otherwise(" below"), F.lit(" par"))
    )


def golden_states(model: DataFrame, probes: int = 60) -> DataFrame:
    """Deterministic probes with their outputs, to check another reader of the model."""
    c = F.col
    i, mb = c("probe"), c("max_balls")
    pace = F.lit(0.9) + (i % 5) * F.lit(0.12)
    scale = F.when(mb == 120, 1.0).otherwise(0.85)
    rows = model.withColumn("probe", F.explode(F.sequence(F.lit(0), F.lit(probes - 1)))).withColumns(
        {
            "balls_left": (mb * ((i * 37) % 100) / F.lit(100.0)).cast("int") + 1,
            "wickets": (i * 7) % 10,
        }
    ).withColumns(
        {
            "runs": ((mb - c("balls_left")) * pace * scale).cast("int"),
            "need": F.lit(1) + (i * 13) % (mb * F.lit(0.9)).cast("int"),
        }
    )
    u, w, r = c("balls_left"), c("wickets"), c("runs")
    return rows.select(
        "format_key", "probe", "balls_left", "wickets", "runs", "need",
        chase_win(u, w, c("need")).alias("chase"), batting_first_win(u, w, r).alias("batting_first"),
        *[v.alias(k) for k, v in projection(u, w, r).items()],
    )
