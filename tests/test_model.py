"""The chase regression and resource fit against plain numpy."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from overstats.operators import winmodel


def newton(xs, wins, trials, ridge=1e-3):
    theta = np.zeros(5)
    for _ in range(50):
        p = 1 / (1 + np.exp(-(xs @ theta)))
        grad = xs.T @ (wins - trials * p) - ridge * theta
        hess = (xs * (trials * p * (1 - p))[:, None]).T @ xs + ridge * np.eye(5)
        step = np.linalg.solve(hess, grad)
        theta = theta + step
        if np.max(np.abs(step)) < 1e-8:
            break
    return theta


def test_regression_recovers_numpy_and_the_planted_weights(spark):
    rng = np.random.default_rng(3)
    true = np.array([0.2, -3.0, 1.0, 0.5, -0.4])
    rows, xs, wins, trials = [], [], [], []
    for i in range(600):
        x, f, w = rng.uniform(-1, 1), rng.uniform(0, 1), rng.integers(0, 10)
        feats = np.array([1.0, x, x * f, f, x * w / 10])
        n = 200.0
        won = float(round(n / (1 + math.exp(-feats @ true))))
        xs.append(feats), wins.append(won), trials.append(n)
        rows.append(("t20i-m", 0, i, int(w), i, *[float(v) for v in feats], won, n))
    df = spark.createDataFrame(
        rows, "format_key string, candidate int, u_bin long, w int, x_bin long, x0 double, x1 double, "
              "x2 double, x3 double, x4 double, wins double, trials double")
    (theta,) = winmodel.fit_logistic(df).values()
    want = newton(np.array(xs), np.array(wins), np.array(trials))
    assert np.allclose(theta, want, atol=1e-6) and np.allclose(theta, true, atol=0.1)


def curve(z, b, us):
    return [(u, z * (1 - math.exp(-b * u))) for u in us]


def test_resources_recover_planted_curves_and_never_gain_from_a_wicket(spark):
    rows = []
    for w, z in ((0, 160.0), (1, 120.0), (2, 130.0)):
        rows += [("t20i-m", 0, 120, w, u, 50.0, 50.0 * y, 50.0 * y * y) for u, y in curve(z, 0.01, range(1, 121, 3))]
    weighted = spark.createDataFrame(
        rows, "format_key string, candidate int, max_balls int, w int, u int, n double, sy double, syy double")
    curves = {r.w: (r.z, r.b) for r in winmodel.fit_curves(weighted).collect()}
    assert abs(curves[0][0] - 160) < 2 and abs(curves[0][1] - 0.01) < 3e-4
    assert curves[5] == curves[2]
    table = {(r.w, r.u): r.resource for r in winmodel.resource_table(winmodel.fit_curves(weighted)).collect()}
    assert all(table[w + 1, u] <= table[w, u] for w in range(9) for u in range(121))
    assert table[2, 100] == table[1, 100]


def test_scoring_is_monotone_and_settles_at_the_ends(spark):
    from overstats.catalog.models import given_model
    from overstats.sources.tables import Tables

    model = given_model(Tables(spark, ""))
    states = spark.createDataFrame(
        [(u, w, need) for u in (6, 60, 120) for w in (0, 5, 9) for need in (1, 40, 150)], "u int, w int, need int")
    got = {(r.u, r.w, r.need): r.p for r in states.join(F.broadcast(model)).select(
        "u", "w", "need", winmodel.chase_win(F.col("u"), F.col("w"), F.col("need")).alias("p")).collect()}
    for (u, w, need), p in got.items():
        assert 0 <= p <= 1
        for (u2, w2, need2), p2 in got.items():
            if (u2, w2) == (u, w) and need2 > need:
                assert p2 <= p
    ends = spark.createDataFrame([(0, 1, 5), (50, 10, 5), (0, 10, 0)], "u int, w int, need int")
    out = ends.join(F.broadcast(model)).select(
        winmodel.chase_win(F.col("u"), F.col("w"), F.col("need"))).collect()
    assert [r[0] for r in out] == [0.0, 0.0, 1.0]


def test_half_lives_are_chosen_by_later_years(spark):
    """Chases used to be won and no longer are: what forgets sooner scores better, and formats with few matches have no choice."""
    years = range(2006, 2020)
    moments, chases, firsts, dates = [], [], [], []
    for y in years:
        for m in range(1, 13):
            day = f"{y}-{m:02d}-10"
            late = y >= 2014
            moments += [("t20i-m", 120, day, 0, u, 5, 5 * 150.0 * (1 - math.exp(-0.01 * u)), 5 * (150.0 * (1 - math.exp(-0.01 * u))) ** 2 + 900.0) for u in (20, 60, 100, 120)]
            chases += [("t20i-m", 120, day, 0, u, need, won, 9 if won != late else 1) for u in (60, 120) for need in (40, 90, 150) for won in (True, False)]
            firsts += [("t20i-m", day, 0, 60, 70, won, 0, 9 if won == late else 1) for won in (True, False)]
            dates += [("t20i-m", f"{day}{k}", day) for k in range(2)] + [("odi-m", f"x{day}", day)][: m // 12]
    frame = spark.createDataFrame
    args = (frame(moments, "format_key string, max_balls int, date string, w int, u int, n long, sy double, syy double"),
            frame(chases, "format_key string, max_balls int, date string, w int, u int, need int, won boolean, n long"),
            frame(firsts, "format_key string, date string, w int, u int, r int, won boolean, stride int, n long"),
            frame([("t20i-m", 0.5)], "format_key string, base_first double"), frame(dates, "format_key string, match_id string, date string"))
    scores = {r.half_life: r.brier for r in winmodel.half_life_scores(*args, "2020-01-01", half_lives=(None, 8.0, 1.0)).collect()}
    assert scores[1.0] < scores[8.0] < scores[None]
    assert winmodel.choose_half_lives(*args, "2020-01-01", half_lives=(None, 8.0, 1.0)) == {"t20i-m": 1.0}
    assert winmodel.choose_half_lives(*args, "2006-02-01") == {}
