"""Rank and score columns. Ties are broken by an id, so every rank is determined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import attach, below_counts, numbered_in


def distinct_rank(df: DataFrame, value: str, item: str, out: str, part: list[str] | None = None) -> DataFrame:
    """0..1 by position in (value, item) order; equal values get different ranks. One row gives 0."""
    placed = numbered_in(df, part or [], [F.col(value), F.col(item)], "_at", "_of")
    return placed.withColumn(out, F.col("_at") / F.greatest(F.col("_of") - 1, F.lit(1))).drop("_at", "_of")


def mid_rank(df: DataFrame, value: str, out: str, part: list[str] | None = None) -> DataFrame:
    """(rows below + rows not above) / 2n: equal values share a rank; one row gives 0.5."""
    part = part or []
    below = below_counts(df, value, {"_rows": F.count("*")}, part)
    share = attach(below, below.groupBy(*part).agg(F.sum("_rows").alias("_n")), part)
    share = share.select(*part, value, ((F.col("below__rows") * 2 + F.col("_rows")) / 2 / F.col("_n")).alias(out))
    return attach(df.drop(out), share, [*part, value])


def z_score(df: DataFrame, value: str, out: str, part: list[str] | None = None) -> DataFrame:
    """Adds the population z-score in each part; a standard deviation of 1e-9 or less counts as 1.

    Mean and deviation are aggregates that are joined back, so a few large parts, or a single one, are no load for one task.
    """
    part = part or []
    facts = df.groupBy(*part).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    z = (F.col(value) - F.col("_mean")) / F.when(F.col("_sd") > 1e-9, F.col("_sd")).otherwise(1.0)
    return attach(df, facts, part).withColumn(out, z).drop("_mean", "_sd")


def sparse_rank(df: DataFrame, value: str, item: str, out: str, missing: float = 0.5) -> DataFrame:
    """Distinct rank among the rows that have a value; the others get ``missing``."""
    has = distinct_rank(df.where(F.col(value).isNotNull()), value, item, out)
    return has.unionByName(df.where(F.col(value).isNull()).withColumn(out, F.lit(missing)))


def stratified_rank(df: DataFrame, value: str, item: str, stratum: str, out: str) -> DataFrame:
    """Distinct rank inside each stratum; alone in a stratum 0.5; without a value -1."""
    placed = numbered_in(df.where(F.col(value).isNotNull()), [stratum], [F.col(value), F.col(item)], "_at", "_of")
    rank = F.when(F.col("_of") == 1, 0.5).otherwise(F.col("_at") / F.greatest(F.col("_of") - 1, F.lit(1)))
    return placed.withColumn(out, rank).drop("_at", "_of").unionByName(df.where(F.col(value).isNull()).withColumn(out, F.lit(-1.0)))


def metric_route(coverage: Column, least: float = 0.6) -> Column:
    """'face' where enough of a set has the face metric, else 'general'."""
    return F.when(coverage < least, "general").otherwise("face")


def composite_score(df: DataFrame, general: str, face: str, item: str, out: str, strategy: str = "auto", vision: str | None = None) -> tuple[DataFrame, str]:
    """Score by one of four strategies, and the one that was used.

    'general' ranks the general metric; 'face' the face metric, 0.5 where it is missing; 'vision_face' the vision
    metric, -1 where it is missing, and falls back to 'face' if no row has it; 'blend' is half general,
    half face.  'auto' takes 'face' if 60 % of the rows have the face metric, else 'general'.
    """
    if strategy == "auto":
        strategy = df.agg(metric_route(F.avg(F.col(face).isNotNull().cast("int"))).alias("s")).first()["s"]
    if strategy == "vision_face" and (vision is None or not df.where(F.col(vision).isNotNull()).take(1)):
        strategy = "face"
    if strategy == "general":
        return distinct_rank(df, general, item, out), strategy
    if strategy == "face":
        return sparse_rank(df, face, item, out), strategy
    if strategy == "vision_face":
        return sparse_rank(df, vision, item, out, -1.0), strategy
    if strategy != "blend":
        raise ValueError(f"unknown strategy {strategy}")
    both = sparse_rank(distinct_rank(df, general, item, "_general"), face, item, "_face")
    return both.withColumn(out, F.col("_general") * 0.5 + F.col("_face") * 0.5).drop("_general", "_face"), strategy


def mode(labels: Column, concentration: Column, use_probe: Column, least: int = 5, most: float = 1.05) -> Column:
    """Whether personal labels are used, by the first guard that holds: none, probe off, too few, too concentrated; else fused."""
    return (
        F.when(labels == 0, "cold").when(~use_probe, "probe off").when(labels < least, "too few")
        .when(concentration > most, "too concentrated").otherwise("fused")
    )


def fusion_weight(n: Column, least: int, full: int, low: float, high: float) -> Column:
    """Weight of personal labels: linear from ``low`` at ``least`` labels to ``high`` at ``full``, clamped."""
    t = F.least(F.greatest((n - least) / (full - least), F.lit(0.0)), F.lit(1.0))
    return F.lit(low) + t * (high - low)


def offline_score(sharp: Column, spread: Column, clean: Column, low_sharp: Column, clipped: Column, flat: Column, top: Column) -> Column:
    """Mix 55/25/20 of mid-ranks less risk penalties, rounded half away from zero, clamped to 0..100."""
    pen = F.when(low_sharp, 30).otherwise(0) + F.when(clipped, 20).otherwise(0) + F.when(flat, 10).otherwise(0)
    mix = F.round(sharp * 55 + spread * 25 + clean * 20, 6)  # sums of shares, so halves are halves
    raw = mix - pen + F.when(top, 5).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round(raw))).cast("int")


def weighted_total(values: list[Column], weights: list[int]) -> Column:
    """Integer mean floor((2 sum + W) / 2W); no weight gives 0."""
    total = sum(weights)
    if total == 0:
        return F.lit(0).cast("long")
    s = sum((v.cast("long") * w for v, w in zip(values, weights, strict=True)), F.lit(0).cast("long"))
    return F.floor((s * 2 + total) / (2 * total)).cast("long")


def clamp_score(x: Column) -> Column:
    """Rounds half up and clamps to 0..100; raises on values that are not finite."""
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.raise_error("score is not finite").cast("int")).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(100), F.floor(x + 0.5))).cast("int")
    )


def segment(index: Column, n: Column, segments: int) -> Column:
    """Segment min(index * S div n, S - 1) of a 0-based index among n rows; S is at least 1."""
    s = max(1, segments)
    return F.least(F.floor(index * s / n), F.lit(s - 1)).cast("int")
