"""Per-delivery flags, phases and extras as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from overstats import config as C


def is_dismissal(kind: Column) -> Column:
    return ~kind.isin(*C.NOT_DISMISSALS)


def bowler_credited(kind: Column) -> Column:
    return ~kind.isin(*C.NOT_BOWLERS)


def team_wickets(wickets: Column) -> Column:
    """Wickets the batting side lost on a ball."""
    one = F.get(wickets, F.lit(0))["kind"]
    return (
        F.when(F.coalesce(F.size(wickets), F.lit(0)) <= 0, 0)
        .when(F.size(wickets) == 1, F.when(is_dismissal(one), 1).otherwise(0))
        .otherwise(F.size(F.filter(wickets, lambda w: is_dismissal(w["kind"]))))
    )


def _first_kind(wickets: Column, test) -> Column:
    """Kind of the first wicket that passes; the usual none or one is direct."""
    one = F.get(wickets, F.lit(0))
    return (
        F.when(F.coalesce(F.size(wickets), F.lit(0)) <= 0, F.lit(None).cast("string"))
        .when(F.size(wickets) == 1, F.when(test(one), one["kind"]))
        .otherwise(F.get(F.filter(wickets, test), F.lit(0))["kind"])
    )


def credited_kind(wickets: Column) -> Column:
    """Kind of the bowler's wicket on a ball (at most one), null if none."""
    return _first_kind(wickets, lambda w: bowler_credited(w["kind"]))


def dismissal_kind_of(wickets: Column, person: Column) -> Column:
    """Kind of the dismissal of ``person`` on a ball, null if none."""
    return _first_kind(
        wickets, lambda w: (w["player_out_id"] == person) & is_dismissal(w["kind"]))


def extras_by_kind(extras: Column) -> dict[str, Column]:
    """Runs of each kind from an ``extras`` map; an absent kind is 0."""
    return {
        kind: F.coalesce(F.try_element_at(extras, F.lit(kind)), F.lit(0)).cast("int")
        for kind in C.EXTRA_KINDS
    }


def phase_of(fmt: Column, over: Column) -> Column:
    """Phase key of a 0-based over; past the end it is the last phase."""

    def within(phases) -> Column:
        expr = None
        for key, _start, end, _label in phases[:-1]:
            test = over < end
            expr = F.when(test, key) if expr is None else expr.when(test, key)
        return expr.otherwise(phases[-1][0])

    t20 = ("t20i", *[k for k, v in C.PHASE_FORMAT.items() if v == "t20i"])
    return (
        F.when(fmt.isin(*t20), within(C.PHASES["t20i"]))
        .when(fmt == "test", within(C.PHASES["test"]))
        .otherwise(within(C.PHASES["odi"]))
    )


def phase_label(fmt: Column, phase: Column) -> Column:
    expr = None
    for key, phases in C.PHASES.items():
        fmts = [key, *[k for k, v in C.PHASE_FORMAT.items() if v == key]]
        for name, _s, _e, label in phases:
            test = fmt.isin(*fmts) & (phase == name)
            expr = F.when(test, label) if expr is None else expr.when(test, label)
    return expr.otherwise(phase)


def entry_phase(faced_before: Column) -> Column:
    """How settled a batter is, from balls faced before this one."""
    return (
        F.when(faced_before < C.NEW_BATTER_BALLS, "new")
        .when(faced_before < C.SETTLED_BATTER_BALLS, "settling")
        .otherwise("set")
    )


def with_flags(deliveries: DataFrame) -> DataFrame:
    """Add the flags every aggregate sums (see the README for the rules)."""
    c = F.col
    return deliveries.withColumns(
        {
            "is_legal": (c("wides") == 0) & (c("noballs") == 0),
            "is_faced": c("wides") == 0,
            "is_four": c("runs_batter") == 4,
            "is_six": c("runs_batter") == 6,
            "is_dot": (c("wides") == 0) & (c("runs_batter") == 0) & (c("runs_total") == 0),
            "team_wickets": team_wickets(c("wickets")),
            "credited_kind": credited_kind(c("wickets")),
            "striker_out_kind": dismissal_kind_of(c("wickets"), c("batter_id")),
            "conceded": c("runs_batter") + c("wides") + c("noballs"),
            "is_bowler_dot": (c("wides") == 0) & (c("noballs") == 0) & (c("runs_total") == 0),
        }
    )


def count_if(flag: Column) -> Column:
    """Sum of a 0/1 flag as a bigint that is 0, not null, on no rows."""
    return F.count(F.when(flag, 1))


def total(value: Column) -> Column:
    return F.coalesce(F.sum(value.cast("bigint")), F.lit(0).cast("bigint"))
