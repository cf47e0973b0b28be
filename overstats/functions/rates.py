"""Derived rates. An undefined rate is null; nothing is rounded here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column, scale: float = 1.0) -> Column:
    """scale * top / bottom, null unless bottom is positive."""
    return F.when(bottom > 0, F.lit(float(scale)) * top / bottom)


def batting_rates(balls="balls", runs="runs", outs="outs", dots="dots",
                  fours="fours", sixes="sixes") -> dict[str, Column]:
    balls, runs, outs = F.col(balls), F.col(runs), F.col(outs)
    dots, fours, sixes = F.col(dots), F.col(fours), F.col(sixes)
    return {
        "average": ratio(runs, outs),
        "strike_rate": ratio(runs, balls, 100),
        "balls_per_dismissal": ratio(balls, outs),
        "dot_pct": ratio(dots, balls, 100),
        "boundary_pct": ratio(fours + sixes, balls, 100),
        "boundary_runs_pct": ratio(fours * 4 + sixes * 6, runs, 100),
    }


def bowling_rates(balls="balls", runs="runs", wickets="wickets", dots="dots",
                  fours="fours", sixes="sixes") -> dict[str, Column]:
    balls, runs, wickets = F.col(balls), F.col(runs), F.col(wickets)
    dots, fours, sixes = F.col(dots), F.col(fours), F.col(sixes)
    return {
        "overs": balls / F.lit(6.0),
        "economy": ratio(runs, balls, 6),
        "average": ratio(runs, wickets),
        "strike_rate": ratio(balls, wickets),
        "dot_pct": ratio(dots, balls, 100),
        "boundary_pct": ratio(fours + sixes, balls, 100),
    }


def phase_rates() -> dict[str, Column]:
    c = F.col
    return {
        "runs_per_over": ratio(c("runs"), c("balls"), 6),
        "balls_per_wicket": ratio(c("balls"), c("wickets")),
        "dot_pct": ratio(c("dots"), c("balls"), 100),
        "boundary_pct": ratio(c("fours") + c("sixes"), c("balls"), 100),
    }


def win_pct(won="won", lost="lost", tied="tied", drawn="drawn") -> Column:
    """No-results are not decided matches."""
    decided = F.col(won) + F.col(lost) + F.col(tied) + F.col(drawn)
    return ratio(F.col(won), decided, 100)


def shrink(value: Column, prior: Column, n: Column, k: Column | float) -> Column:
    """Pull a small sample towards its prior; equal weight at ``n == k``."""
    k = F.lit(k) if isinstance(k, float) else k
    weight = n / (n + k)
    return F.when(n <= 0, prior).otherwise(weight * value + (F.lit(1.0) - weight) * prior)


def wilson_interval(successes: Column, trials: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval for a proportion; (0, 1) without trials."""
    n = trials.cast("double")
    p = successes / n
    zz = F.lit(z * z)
    denom = F.lit(1.0) + zz / n
    centre = (p + zz / (F.lit(2.0) * n)) / denom
    spread = F.sqrt(p * (F.lit(1.0) - p) / n + zz / (F.lit(4.0) * n * n))
    margin = F.lit(z) * spread / denom
    low = F.when(trials > 0, F.greatest(F.lit(0.0), centre - margin)).otherwise(0.0)
    high = F.when(trials > 0, F.least(F.lit(1.0), centre + margin)).otherwise(1.0)
    return low, high


def confidence(balls: Column, gate: Column) -> Column:
    return (
        F.when(balls >= gate * 3, "high").when(balls >= gate * 1.5, "medium").otherwise("low")
    )


def recency_weight(date: Column, newest: Column, half_life: Column | float | None) -> Column:
    """0.5 ** (years before the newest match / half-life); ISO date strings."""
    if half_life is None:
        return F.lit(1.0)
    part = lambda d, at, n: F.substring(d, at, n).cast("int")
    years = (part(newest, 1, 4) - part(date, 1, 4)) + (
        part(newest, 6, 2) - part(date, 6, 2)
    ) / F.lit(12.0)
    half_life = F.lit(half_life) if isinstance(half_life, float) else half_life
    return F.when(half_life.isNull(), 1.0).otherwise(F.pow(F.lit(0.5), years / half_life))
