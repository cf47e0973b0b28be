"""Bounded samples of labelled texts: short texts by a hash, and the shortest longer ones where a group lacks short ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = 1 << 30
#: Longer texts are told apart by so many steps to a doubling of their bytes.
TO_DOUBLE = 4
#: Steps that a text of 2 GB can reach, with any limit of a byte or more.
STEPS = 31 * TO_DOUBLE + 2
#: So many times the rows that are wanted pass the threshold on the hash.
MORE = 4


def step(size: Column, limit: int) -> Column:
    """0 for texts up to ``limit`` bytes, then 1, 2, ...: the shorter, the smaller."""
    return F.when(size <= limit, 0).otherwise(1 + F.floor(TO_DOUBLE * F.log2(size / limit))).cast("int")


def passing(counts: list[tuple[object, int, int]], each: int, group: Column, step: Column, order: Column) -> Column:
    """Which rows come into question for ``each`` rows of every group, by step, then hash (``order``).

    ``counts`` holds (group, step, number of different hashes). Of every group the first steps pass whole until the one that reaches ``each``; of that
    one a few times as many pass as are missing, so that no task gathers more.
    """
    have: dict = {}
    bounds = []
    for name, at, n in sorted(counts, key=lambda x: x[1]):
        missing = each - have.get(name, 0)
        if missing > 0:
            bounds += [F.lit(f"{at}:{name}"), F.lit(int(RANGE * min(1.0, MORE * missing / n)) + 1)]
        have[name] = have.get(name, 0) + n
    key = F.concat(step.cast("string"), F.lit(":"), group.cast("string"))
    return F.coalesce(F.pmod(order, F.lit(RANGE)) < F.create_map(*bounds)[key], F.lit(False))
