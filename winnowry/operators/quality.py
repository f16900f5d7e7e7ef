"""Sharpness risks: each item against the median of its family, or of all items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import attach, medians

#: An item is a risk below these shares of the median of its family, or of all items if it has none.
FAMILY_SHARE, LIBRARY_SHARE = 0.55, 0.35
LOW_SHARPNESS, LOW_CONTRAST = "low_sharpness", "low_contrast"


def sharpness_risks(items: DataFrame, family: str, sharpness: str, risks: str) -> DataFrame:
    """The items with ``risks`` (an array of names) made anew: low_sharpness first where it holds, and nowhere else.

    The median is the family's if any of its items has a sharpness, else that of all items, with a lower share.  Items of
    low contrast, without a sharpness, or with a median of 0 or less are no such risk.  A null family is no family; null risks stay null without a sharpness and count as none with one.
    """
    own = medians(items.where(F.col(family).isNotNull()), sharpness, [family], "_own").drop("n")
    every = medians(items, sharpness, [], "_all").select(F.max("_all").alias("_all"))  # one row, also without items
    out = attach(attach_left(items, own, family), every, [])
    reference, share = F.coalesce("_own", "_all"), F.when(F.col("_own").isNull(), LIBRARY_SHARE).otherwise(FAMILY_SHARE)
    rest = F.array_remove(F.coalesce(F.col(risks), F.array().cast("array<string>")), LOW_SHARPNESS)
    low = (reference > 0) & ~F.array_contains(rest, LOW_CONTRAST) & (F.col(sharpness) < reference * share)
    made = F.when(F.coalesce(low, F.lit(False)), F.concat(F.array(F.lit(LOW_SHARPNESS)), rest)).otherwise(rest)
    return out.withColumn(risks, F.when(F.col(sharpness).isNull(), F.col(risks)).otherwise(made)).drop("_own", "_all")


def attach_left(df: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """All rows of ``df`` with the columns of ``facts``, which has one row for each key and none for null."""
    named = facts.withColumnRenamed(key, "_key")
    return df.join(named, df[key] == named["_key"], "left").drop("_key")
