"""Mixing sources to target weights by systematic sampling.

Each source gets a target size; a document's expected copies are target / source size.
Within a source the expected copies are prefix-summed, one random offset is added, and a
document is taken once for every integer boundary its span crosses.  The sums are exact
integers, computed range by range, so a source that holds most rows is spread over all
tasks and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packed import column
from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
_UNIT = 1 << 24


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(
    df: DataFrame, store: Scratch, group: list[str], order: list[Column], values: dict[str, Column], parts: int
) -> DataFrame:
    """Adds, for each name, the sum of its value over the rows before, in ``order`` within ``group``.

    Rows are range-partitioned; partial sums of ranges (at most groups + parts rows) give
    each range its start.  No task sees more than one range of a group.
    """
    keys = [F.col(g) for g in group]
    t = df.withColumns({f"_{n}": v for n, v in values.items()})
    t = store.keep(t.repartitionByRange(parts, *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = t.groupBy(*keys, "_range").agg(*[F.sum(f"_{n}").alias(f"_{n}_in") for n in values])
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, "_range", *[F.coalesce(F.sum(f"_{n}_in").over(before), F.lit(0)).alias(f"_{n}_at") for n in values])
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.join(starts, [*group, "_range"])
    return t.withColumns(
        {n: F.col(f"_{n}_at") + F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) for n in values}
    ).drop("_range", *[f"_{n}" for n in values], *[f"_{n}_at" for n in values])


def source_targets(
    sources: DataFrame, store: Scratch, weights: tuple[int, ...], percent: int, most: int
) -> DataFrame:
    """Adds target to (src, none, source_size): shares by weight, none above most * source_size.

    Sources by code point, nulls last, take the weights in turn; together they get
    ``percent`` of all words.  A source that would exceed its cap stops there, and the rest
    is shared again by weight: in order of cap per weight, the capped sources are those that
    still exceed their cap when all before them have taken theirs.
    """
    ranked = prefix_sums(sources, store, [], [F.col("none"), F.col("src")], {"rank": F.lit(1)}, 8)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = store.keep(ranked.withColumn("w", w.cast("long")), "weights")
    total, all_w = ranked.agg(F.sum("source_size"), F.sum("w")).first()
    total, all_w = total or 0, all_w or 0
    ratio = F.col("source_size") / F.col("w")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    s = prefix_sums(
        ranked, store, [], [ratio, F.col("none"), F.col("src")], {"s0": F.col("source_size"), "w0": F.col("w")}, 8
    )
    left = F.lit(percent * total).cast("decimal(38,0)") - F.lit(100 * most).cast("decimal(4,0)") * wide("s0")
    capped = wide("w") * left.cast("decimal(30,0)") >= (
        (wide("source_size") * 100 * most).cast("decimal(30,0)") * (F.lit(all_w) - F.col("w0")).cast("decimal(8,0)")
    )
    s = store.keep(s.withColumn("capped", capped), "targets")
    caps, free_w = s.agg(
        F.sum(F.when(F.col("capped"), F.col("source_size"))), F.sum(F.when(~F.col("capped"), F.col("w")))
    ).first()
    rest = percent * total - 100 * most * (caps or 0)
    share = (F.col("w") * F.lit(rest)).cast("double") / F.lit(float(100 * (free_w or 1)))
    return s.select("src", "none", "source_size", F.when(F.col("capped"), (F.col("source_size") * most).cast("double")).otherwise(share).alias("target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (3, 1, 2),
    percent: int = 150,
    most: int = 2,
    seed: str = "mix",
    parts: int | None = None,
    slim: bool = False,
) -> DataFrame:
    """Rows of ``docs`` packed as struct ``row`` (only the id if ``slim``) with size, source_size, target and copies.

    A document's size is its number of words.  Within a source documents go by size, largest
    first, then id: neighbours have like sizes, so the words taken come near the target.
    copies is the number of times the mix takes the document, at most ``most``.

    Defined cases: null text has size 0; a null source is a source of its own, last in
    order; a source without words has target 0 and gives no copies; equal rows are
    interchangeable; null ids sort last; no rows give no rows; other columns stay in ``row``.
    """
    spark = docs.sparkSession
    store = Scratch(spark, "mix")
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = docs.select(
        F.struct(*[column(c).alias(c) for c in ([id_col] if slim else docs.columns)]).alias("row"),
        F.coalesce(F.col(source_col), F.lit("")).alias("src"),
        F.col(source_col).isNull().alias("none"),
        word_count(F.col(text_col)).alias("size"),
        F.col(id_col).alias("_id"),
        F.xxhash64(text_col).alias("_tie"),
    )
    sources = store.keep(base.groupBy("src", "none").agg(F.sum("size").alias("source_size")), "sources")
    targets = source_targets(sources, store, weights, percent, most)
    expect = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * _UNIT + 0.5)).otherwise(0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("src"), F.lit("|"), F.col("none").cast("string"))), 1, 6), 16, 10)
    targets = store.keep(targets.withColumn("each", expect.cast("long")).withColumn("offset", offset.cast("long")), "shares")
    order = [F.col("size").desc(), F.col("_id").asc_nulls_last(), F.col("_tie")]
    spans = prefix_sums(base, store, ["src", "none"], order, {"place": F.lit(1).cast("long")}, parts)
    spans = spans.join(targets, ["src", "none"])
    start = F.col("place") * F.col("each") + F.col("offset")
    copies = F.shiftright(start + F.col("each"), 24) - F.shiftright(start, 24)
    return spans.select("row", "size", "source_size", "target", copies.alias("copies"))


def taken(mixed: DataFrame) -> DataFrame:
    """The documents of a mix, each as often as it is taken."""
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_n")).select("row.*")


#: DuckDB SQL of the digest query.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS none,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
s AS (SELECT src, none, sum(size)::HUGEINT AS ssize FROM d GROUP BY ALL),
r AS (SELECT *, ([3,1,2])[((row_number() OVER (ORDER BY none, src) - 1) % 3 + 1)::INT]::HUGEINT AS w FROM s),
p AS (
  SELECT *, sum(ssize) OVER () AS total, sum(w) OVER () AS allw,
         coalesce(sum(ssize) OVER o, 0) AS s0, coalesce(sum(w) OVER o, 0) AS w0
  FROM r WINDOW o AS (ORDER BY ssize::DOUBLE / w::DOUBLE, none, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, w * (150 * total - 200 * s0) >= 200 * ssize * (allw - w0) AS capped FROM p),
f AS (SELECT *, coalesce(sum(ssize) FILTER (capped) OVER (), 0) AS caps, coalesce(sum(w) FILTER (NOT capped) OVER (), 1) AS freew FROM c),
t AS (
  SELECT src, none, ssize,
         CASE WHEN capped THEN (2 * ssize)::DOUBLE
              ELSE (w * (150 * total - 200 * caps))::DOUBLE / (100 * freew)::DOUBLE END AS target,
         ('0x' || substr(md5('mix|' || src || '|' || none::VARCHAR), 1, 6))::BIGINT AS u
  FROM f),
e AS (SELECT *, CASE WHEN ssize > 0 THEN floor(target / ssize::DOUBLE * 16777216 + 0.5)::BIGINT ELSE 0 END AS each FROM t),
q AS (
  SELECT d.doc_id, d.size, e.ssize, e.target, e.u, e.each,
         row_number() OVER (PARTITION BY d.src, d.none ORDER BY d.size DESC, d.doc_id) - 1 AS place
  FROM d JOIN e ON d.src = e.src AND d.none = e.none)
SELECT doc_id, size, ssize::BIGINT AS source_size, target,
       (((place * each + u + each) >> 24) - ((place * each + u) >> 24)) * size AS taken
FROM q
"""
