"""Places in one order of a whole table, without a task that sees the whole table.

Rows are dealt to ranges of the order and stored with the number of their range; a window
numbers the rows of each range, and the rows of all ranges before are added from a table with
one row for each range.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    return stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))


def _before(ranges: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """For each range the sums over the ranges before it; ranges are as many as shuffle partitions at most."""
    per = ranges.groupBy("_range").agg(*[v.alias(k) for k, v in sums.items()])
    low = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    return per.select("_range", *[F.coalesce(F.sum(k).over(low), F.lit(0).cast(per.schema[k].dataType)).alias(f"_{k}") for k in sums])


def numbered(df: DataFrame, order: list[Column], out: str, start: int = 0) -> DataFrame:
    """Adds the place of each row in the order, from ``start`` on; the order should have no ties.

    Ties are placed in an order of Spark's choice; nulls come where the order's columns put them; no rows give no rows.
    """
    ranges = _ranged(df, order)
    before = _before(ranges, {"rows": F.count("*")})
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.join(F.broadcast(before), "_range").withColumn(out, place + F.col("_rows") - 1 + start).drop("_range", "_rows")


def running_sum(df: DataFrame, order: list[Column], value: Column, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to and with each row in the order, which should have no ties."""
    ranges = _ranged(df.withColumn("_value", value), order)
    before = _before(ranges, {"sum": F.sum("_value")})
    own = F.sum("_value").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranges.join(F.broadcast(before), "_range").withColumn(out, own + F.col("_sum")).drop("_range", "_sum", "_value")


def attach(df: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the columns of ``facts``, which has one row for each key; nulls match, and no keys mean one row for all."""
    if not keys:
        return df.crossJoin(F.broadcast(facts))
    named = facts.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    return df.join(named, same).drop(*[f"_key_{i}" for i in range(len(keys))])


def numbered_in(df: DataFrame, groups: list[str], order: list[Column], out: str, count: str = "_count") -> DataFrame:
    """Adds the 0-based place of each row inside its group, and as ``count`` the rows of its group.

    One global order by group and ``order``, less the first place of the group; so a few large
    groups, or a single one, are spread over all tasks.  Null is a group of its own.
    """
    placed = numbered(df, [*map(F.col, groups), *order], "_place")
    size = df.groupBy(*groups).agg(F.count("*").alias(count))
    if groups:
        size = running_sum(size, [F.col(g) for g in groups], F.col(count), "_to")
    else:
        size = size.withColumn("_to", F.col(count))
    placed = attach(placed, size, groups)
    return placed.withColumn(out, F.col("_place") - F.col("_to") + F.col(count)).drop("_place", "_to")


def below_counts(df: DataFrame, value: str, parts: dict[str, Column], groups: list[str]) -> DataFrame:
    """One row for each distinct value of a group with the counts ``parts`` and ``below_<part>`` of the group's smaller values' rows.

    Counts by value come first, so a value that many rows share is one row in the order.
    """
    counts = df.groupBy(*groups, value).agg(*[v.cast("long").alias(k) for k, v in parts.items()])
    order = [*map(F.col, groups), F.col(value)]
    ranges = _ranged(counts, order)
    before = _before(ranges, {k: F.sum(k) for k in parts})
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    below = [(F.coalesce(F.sum(k).over(w), F.lit(0)) + F.col(f"_{k}")).alias(f"below_{k}") for k in parts]
    out = ranges.join(F.broadcast(before), "_range").select(*groups, value, *parts, *below)
    start = out.groupBy(*groups).agg(*[F.min(f"below_{k}").alias(f"_from_{k}") for k in parts])
    return attach(out, start, groups).select(*groups, value, *parts, *[(F.col(f"below_{k}") - F.col(f"_from_{k}")).alias(f"below_{k}") for k in parts])


def at_ranks(df: DataFrame, value: str, groups: list[str], picks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row (groups, n, picks) for each group: the values at 0-based ranks, each a function of the group's number of values.

    Values are counted first, and places come from one global order of distinct values, so no task and no state holds a
    group.  Null values are left out; a group without any has no row.  Null is a group of its own.
    """
    below = below_counts(df.where(F.col(value).isNotNull()), value, {"_rows": F.count("*")}, groups)
    at = attach(below, below.groupBy(*groups).agg(F.sum("_rows").alias("n")), groups)
    here = lambda rank: (rank >= F.col("below__rows")) & (rank < F.col("below__rows") + F.col("_rows"))
    chosen = [F.max(F.when(here(rank(F.col("n"))), F.col(value))).alias(name) for name, rank in picks.items()]
    return at.groupBy(*groups).agg(F.max("n").alias("n"), *chosen)


def medians(df: DataFrame, value: str, groups: list[str], out: str = "median") -> DataFrame:
    """(groups, n, out): exact medians, the mean of the two middle values of an even number."""
    middle = at_ranks(df, value, groups, {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.floor(n / 2)})
    return middle.withColumn(out, (F.col("_low") + F.col("_high")) / 2).drop("_low", "_high")


def nearest(q: float) -> Callable[[Column], Column]:
    """Rank of a quantile by the nearest row: the q n-th from 0 on, the last at most."""
    return lambda n: F.least(F.floor(n * q), n - 1)
