"""Folders of recorded runs: run.json, calls.jsonl and verdict files of two stages, joined by the folder they lie in."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STAGE = "status: string, error: string, comparisons: long, preflights: long, anchor_photos_sent: long, anchor_jpegs_sent: long"
_PLAN = "array<struct<segment: long, a: string, b: string>>"
#: What is read of run.json; fields that a run has no use for are null.
RUN = (
    "config struct<stage3Vlm: boolean, stage3RubricFile: string, stage3AnchorsFile: string>, stage3_inputs struct<rubric_md5: string, rubric_chars: long>, "
    f"stage2 struct<{_STAGE}>, stage3 struct<{_STAGE}, plan_md5: string, plan: {_PLAN}, note: struct<missing: long, unused: long>>, "
    "delivered_after_stage2 array<string>, delivered_final array<string>, started_at string"
)
CALL = "stage int, sent boolean, ok boolean, kind string, jpegs int, elapsed_ms double, error string"
VERDICTS = f"plan_md5 string, plan {_PLAN}, verdicts array<struct<a: string, b: string, winner: string, consistent: boolean, code_read_ok: boolean, contradiction: boolean>>"


@dataclass(frozen=True)
class Records:
    """runs (run, ...), calls (run, ...) and verdicts (run, stage, ...); run is the folder's path below the root."""

    runs: DataFrame
    calls: DataFrame
    verdicts: DataFrame


def _folder(root: str) -> Column:
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # paths come encoded, but a plus stays one
    plain = F.regexp_replace(path, "^[a-z]+:/+", "/")
    below = F.substring(plain, F.lit(len("/" + root.split(":")[-1].strip("/") + "/") + 1), F.length(plain))
    return F.regexp_replace(below, "/?[^/]+$", "")


def _whole(spark: SparkSession, root: str, schema: str, name: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(root)


def read_records(spark: SparkSession, root: str) -> Records:
    """All runs below ``root``, at any depth; half-written lines of calls are dropped, a run may lack any file but run.json."""
    run = _folder(root).alias("run")
    calls = spark.read.schema(CALL).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "calls.jsonl").json(root)
    stage = F.regexp_extract(F.col("_metadata.file_name"), "^stage([23])", 1).cast("int").alias("stage")
    return Records(
        _whole(spark, root, RUN, "run.json").select(run, "*"), calls.select(run, "*"), _whole(spark, root, VERDICTS, "stage[23]-verdicts.json").select(run, stage, "*")
    )
