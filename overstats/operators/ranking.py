"""Top-k, exact ranks and exact quantiles that survive a hot group."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from overstats.session import materialise

#: Ranges of (group, value) that ranked values are dealt into, unless there are more shuffle partitions.
RANGES = 16


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                  rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in a total order, with their rank.

    Written as row_number <= k so that Spark trims every task's groups to
    ``k`` rows before the shuffle, however many rows a group has.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def pool_ranks(values: DataFrame, keys: Sequence[str], value: str,
               pool: str | None = None) -> DataFrame:
    """For each distinct value of a group: how many are below it, tie, and in all.

    With ``pool`` (a boolean column) only those rows are counted, but every
    value gets its ranks. Null values have none. Exact, and no task holds more
    of a group than its share of all rows: values are folded to (value, count),
    dealt by ranges of (group, value) and numbered by range. A group within one
    range is ranked on its own. Of the others, two a range at most, each piece is
    ranked on its own and lifted by the counts of the pieces before it, which
    are few enough to go to every task.
    """
    keys = list(keys)
    spark = values.sparkSession
    ranges = max(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    member = F.lit(1) if pool is None else F.when(F.col(pool), 1)
    counted = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(member).alias("ties"))
    ranged = materialise(counted.repartitionByRange(ranges, *keys, value).withColumn("_range", F.spark_partition_id()), "ranges")
    group = Window.partitionBy(*keys)
    before = Window.unboundedPreceding, -1
    pieces = ranged.groupBy(*keys, "_range").agg(F.sum("ties").alias("_in_piece")).withColumns({
        "_pieces": F.count(F.lit(1)).over(group), "n": F.sum("_in_piece").over(group),
        "_lift": F.coalesce(F.sum("_in_piece").over(group.orderBy("_range").rowsBetween(*before)), F.lit(0)),
    }).where("_pieces > 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_of"), "_lift", "n")
    pieces = F.broadcast(materialise(pieces, "pieces"))  # a range has a first and a last group: two rows a range at most
    own = functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_range") == F.col("_of"))
    inside = Window.partitionBy("_range", *keys).orderBy(value).rowsBetween(*before)
    split = ranged.join(pieces, own).repartitionByRange(ranges, "_range").select(
        *keys, value, (F.col("_lift") + F.coalesce(F.sum("ties").over(inside), F.lit(0))).alias("below"), "ties", "n")
    whole = ranged.join(pieces, own, "left_anti").select(
        *keys, value, F.coalesce(F.sum("ties").over(group.orderBy(value).rowsBetween(*before)), F.lit(0)).alias("below"), "ties", F.sum("ties").over(group).alias("n"))
    return whole.unionByName(split)


def mid_rank(below: Column, ties: Column, n: Column, higher_is_better: Column) -> Column:
    """Percentile of a value at the middle of its ties, 0-100; 50 if alone."""
    pct = F.lit(100.0) * ((below + below + ties) / F.lit(2.0)) / n
    pct = F.when(n > 0, pct).otherwise(50.0)
    return F.when(higher_is_better, pct).otherwise(F.lit(100.0) - pct)


def ranks_against_pool(candidates: DataFrame, keys: Sequence[str], value: str,
                       pool: str) -> DataFrame:
    """Every candidate with its value's ranks among the rows flagged as pool."""
    return candidates.join(pool_ranks(candidates, keys, value, pool), [*keys, value])


def quantiles(values: DataFrame, keys: Sequence[str], value: str,
              points: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles of each group, one column a point.

    Read off the ranked distinct values: quantile q sits between the order
    statistics around (n - 1) * q.
    """
    return pool_quantiles(pool_ranks(values, keys, value), keys, value, points)


def pool_quantiles(ranked: DataFrame, keys: Sequence[str], value: str,
                   points: Sequence[float]) -> DataFrame:
    """Quantiles from rows carrying below / ties / n (rows without ties don't count)."""
    c = F.col
    held = lambda pos: (c("ties") > 0) & (c("below") <= pos) & (pos < c("below") + c("ties"))
    aggs = []
    for q in points:
        pos = (c("n") - 1) * F.lit(float(q))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when(held(at), c(value))).alias(f"_{side}{round(q * 1000)}"))
    out = ranked.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    named = {}
    for q in points:
        lo, hi = c(f"_lo{round(q * 1000)}"), c(f"_hi{round(q * 1000)}")
        pos = (c("n") - 1) * F.lit(float(q))
        named[f"p{round(q * 100)}"] = lo + (hi - lo) * (pos - F.floor(pos))
    return out.withColumns(named).select(*keys, "n", *named)


def dedupe_largest(df: DataFrame, key: str, size: str, position: str) -> DataFrame:
    """One row per key: the largest, the earliest on a tie."""
    return df.groupBy(key).agg(
        F.max_by(F.struct(*df.columns), F.struct(F.col(size), -F.col(position))).alias("_kept")
    ).select("_kept.*")


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page of an ordered listing."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes begin at 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def ordered(order: Sequence[tuple[str, bool]]) -> tuple[Column, ...]:
    """Sort columns of (name, ascending) pairs, nulls last."""
    return tuple(F.col(k).asc_nulls_last() if up else F.col(k).desc_nulls_last() for k, up in order)


def cursor_of(row: Row, order: Sequence[tuple[str, bool]]) -> list:
    """Where a row stands in the order: what :func:`after` needs to go on behind it."""
    return [row[k] for k, _ in order]


def after(df: DataFrame, order: Sequence[tuple[str, bool]], cursor: Sequence | None = None, size: int = 50) -> DataFrame:
    """The ``size`` rows behind ``cursor`` (the first ones without) in an order that must tell rows apart.

    However deep the listing, every task keeps ``size`` rows: what lies before the cursor is filtered out where it is read,
    and isn't counted off. Rows that come and go before the cursor don't shift the page.
    """
    if size < 1:
        raise ValueError("pages begin at 1 row")
    if cursor is not None:
        behind, equal = F.lit(False), F.lit(True)
        for (name, up), value in zip(order, cursor, strict=True):
            column = F.col(name)
            if value is not None:
                beyond = column > F.lit(value) if up else column < F.lit(value)
                behind = behind | (equal & (F.coalesce(beyond, F.lit(False)) | column.isNull()))
            equal = equal & column.eqNullSafe(F.lit(value))
        df = df.where(behind)
    return df.orderBy(*ordered(order)).limit(size)


def page_numbers(total: int, number: int, size: int) -> dict[str, int | bool | None]:
    """Where a page sits; a page past the end leads back to the last one."""
    pages = max(1, -(-total // size))
    return {
        "pages": pages,
        "past_end": number > pages,
        "previous": min(number - 1, pages) if number > 1 else None,
        "next": number + 1 if number < pages else None,
    }


def rolling_mean(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str,
                 width: int, into: str = "rolling") -> DataFrame:
    """Trailing mean over ``width`` rows, null until the window is full."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(width - 1), 0)
    full = F.count(F.lit(1)).over(frame) == width
    return df.withColumn(into, F.when(full, F.sum(value).over(frame) / F.lit(float(width))))


def moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 below two values) and exact median."""
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev")
    )
    median = quantiles(df, keys, value, (0.5,)).drop("n").withColumnRenamed("p50", "median")
    return stats.join(median, list(keys))
