"""Joins with tables that know how often each of their keys occurs, so that frequent keys need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is frequent if it has more than one of so many rows; so there are fewer frequent keys than this.
SHARE = 4096


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has every key once and in ``count`` how many of ``rows`` have it, or more.

    The rows of frequent keys, fewer than SHARE keys whatever the size of the input, are joined by a broadcast
    of these keys; all others are shuffled, and none of their keys has more than one of SHARE rows.  ``rows`` and ``table`` are read twice and should be stored.

    Defined cases: keys with nulls join nothing; without rows the result is empty.
    """
    if total is None:
        total = table.agg(F.sum(count)).first()[0] or 0
    often = F.col(count) * SHARE > total
    few, others = table.where(often), table.where(~often)
    hot = rows.join(F.broadcast(few), keys)
    rest = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti")
    return hot.unionByName(rest.join(others, keys).select(*hot.columns))
