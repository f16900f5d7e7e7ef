"""Disjoint sets over shared keys, and the ends of chains, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import dropped, stored


def chain_ends(steps: DataFrame) -> DataFrame:
    """(item, root): where each item comes to if it follows ``steps`` (item, next) to the last; without circles.

    A round doubles the steps, so a chain of n takes log2 n of them.  An item without a row is its own end and has no row.
    """
    cur = stored(steps.select("item", F.col("next").alias("root")))
    while True:
        ahead = cur.select(F.col("item").alias("root"), F.col("root").alias("further"))
        new = stored(cur.join(ahead, "root", "left").select("item", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        dropped(cur)
        cur = new.select("item", "root")
        cur._stored_path = new._stored_path
        if not new.where("moved").take(1):
            return cur


def connected(edges: DataFrame) -> DataFrame:
    """(item, root): the smallest item that edges (a, b) lead to, for every item that has an edge.

    A round lets every set point to the smallest of its neighbours that is smaller, follows these pointers to their ends, and
    draws the edges between the ends.  Each set that still has an edge joins another one or is joined, so the number of sets at
    least halves.  Edges with a null or to the same item are left out; no edges give no rows.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    roots: DataFrame | None = None
    while pairs.take(1):
        up = pairs.groupBy("a").agg(F.min("b").alias("next")).withColumnRenamed("a", "item")
        tips = chain_ends(up)
        lowest = pairs.select(F.col("b").alias("item")).distinct().join(tips.select("item"), "item", "left_anti")
        ends = tips.unionByName(lowest.select("item", F.col("item").alias("root")))
        if roots is None:
            new = stored(ends)
        else:
            of = ends.select(F.col("item").alias("root"), F.col("root").alias("to"))
            new = stored(roots.join(of, "root", "left").select("item", F.coalesce("to", "root").alias("root")))
            dropped(roots)
        roots = new
        to = lambda c: ends.select(F.col("item").alias(c), F.col("root").alias(f"r{c}"))
        left = pairs.join(to("a"), "a").join(to("b"), "b").where("ra <> rb")
        smaller = stored(left.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
        dropped(pairs, tips)
        pairs = smaller
    return roots if roots is not None else pairs.select(F.col("a").alias("item"), F.col("b").alias("root"))


def families(members: DataFrame, item: str, keys: list[str]) -> DataFrame:
    """(item, family, size): items that share a value in any of the columns ``keys``, directly or over others; family is the smallest item.

    Only families of two or more have rows.  A key becomes a star around its smallest item, so a key that a large share
    of all items has gives one edge for each, and never a pair of all.  Null keys join nothing.
    """
    tall = members.select(F.col(item).alias("item"), F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.col(k).cast("string").alias("key")) for i, k in enumerate(keys)])).alias("k"))
    tall = tall.select("item", "k.kind", "k.key").where("item IS NOT NULL AND key IS NOT NULL")
    first = tall.groupBy("kind", "key").agg(F.min("item").alias("b"), F.max("item").alias("top")).where("b <> top").drop("top")
    roots = stored(connected(tall.join(first, ["kind", "key"]).select(F.col("item").alias("a"), "b")))
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    return roots.join(sizes, "root").select(F.col("item").alias(item), F.col("root").alias("family"), "size")
