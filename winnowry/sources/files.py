"""File listings, fingerprints, caches, record readers and guarded sinks.

Items are keyed by relative path, never by bare name, so equal names in two folders stay apart.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import natural_key

#: Suffixes of image files.
SUFFIXES = ("jpg", "jpeg", "png", "heic", "tif", "tiff", "webp")
VERDICT = T.StructType([T.StructField(c, T.StringType()) for c in ("a", "b", "winner")])


def excluded(rel: Column, prefixes: Iterable[str]) -> Column:
    """Whether a relative path is one of the prefixes or lies below one."""
    out = F.lit(False)
    for p in prefixes:
        p = p.strip("/")
        out = out | (rel == p) | rel.startswith(p + "/")
    return out


def list_items(spark: SparkSession, folder: str, exclude: Iterable[str] = (), suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """(rel, size, modified) of files below a folder, by path; excluded ones are never opened."""
    root = folder.rstrip("/") + "/"
    glob = "*.{" + ",".join(sorted({s for x in suffixes for s in (x.lower(), x.upper())})) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    plain = re.sub(r"^[a-z]+:/*", "/", root)
    rel = F.expr(f"substring(regexp_replace(path, '^[a-z]+:/+', '/'), {len(plain) + 1})")
    out = files.select(rel.alias("rel"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out.where(~excluded(F.col("rel"), exclude))


def natural_order(items: DataFrame, name: str = "rel") -> DataFrame:
    """Items without hidden names, in numeric-aware order."""
    return items.where(~F.col(name).rlike(r"(^|/)\.")).orderBy(natural_key(F.col(name)), name)


def dataset_fingerprint(items: DataFrame) -> DataFrame:
    """(fingerprint): 16 hex digits over ordered rel|size|time lines."""
    line = F.concat_ws("|", "rel", F.col("size").cast("string"), F.unix_micros("modified").cast("string"))
    return items.agg(F.substring(F.sha2(F.concat(F.array_join(F.array_sort(F.collect_list(line)), "\n"), F.lit("\n")), 256), 1, 16).alias("fingerprint"))


def missing_entries(wanted: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """What a cache keyed by content still lacks."""
    return wanted.join(cached.select(key), key, "left_anti")


def cache_valid(wanted: DataFrame, cached: DataFrame, key: str) -> bool:
    """Whether a cache holds exactly the wanted keys."""
    a, b = wanted.select(key), cached.select(key)
    return not a.exceptAll(b).take(1) and not b.exceptAll(a).take(1)


def _table_at(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.parquet(path)


def build_cache(wanted: DataFrame, path: str, key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache's entries for ``wanted`` (one row for each key); only keys that it lacks are made, and added to it.

    ``make`` turns wanted rows into entries with the key.  Keys come from content, so a changed item has another key and
    old entries stay for whoever still wants them.
    """
    spark, cached = wanted.sparkSession, _table_at(wanted.sparkSession, path)
    lacking = wanted if cached is None else missing_entries(wanted, cached, key)
    if cached is None or lacking.take(1):
        make(lacking).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(wanted.select(key).distinct(), key, "left_semi")


def whole_cache(wanted: DataFrame, path: str, key: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A cache that is good only as a whole: with exactly the wanted keys it is read, otherwise made anew."""
    cached = _table_at(wanted.sparkSession, path)
    if cached is None or not cache_valid(wanted, cached, key):
        make(wanted).write.mode("overwrite").parquet(path)
    return wanted.sparkSession.read.parquet(path)


def read_lines(spark: SparkSession, path: str, known: DataFrame, item: str) -> DataFrame:
    """Trimmed lines of a list file that are known items."""
    lines = spark.read.text(path).select(F.trim("value").alias(item)).where(F.length(item) > 0).distinct()
    return lines.join(known.select(item), item, "left_semi")


def read_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, winner) rows of a JSON-lines file; an unknown winner raises."""
    rows = spark.read.schema(VERDICT).json(path)
    known = F.col("winner").isin("a", "b", "tie", "neither", "inconsistent")
    bad = F.raise_error(F.concat(F.lit("unknown verdict: "), F.coalesce("winner", F.lit("null"))))
    return rows.withColumn("winner", F.when(F.coalesce(known, F.lit(False)), F.col("winner")).otherwise(bad.cast("string")))


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines without those that are half written."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_results(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows of JSON lines, and the raw text of every dropped one."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    raw = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    rows = raw.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"), "value")
    return rows.where("r._corrupt IS NULL").select("r.*").drop("_corrupt"), rows.where("r._corrupt IS NOT NULL").select("value")


def read_runs(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """run.json of every run folder, with the folder's name as run_id."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "run.json").json(root)
    return rows.withColumn("run_id", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/run\.json$", 1))


def guard_sink(destination: str, sources: Iterable[str], roots: Iterable[str] = ()) -> str:
    """Refuses a destination inside a source, or outside the allowed roots."""
    parts = lambda p: [x for x in re.sub(r"^[a-z]+:/*", "/", p).split("/") if x not in ("", ".")]
    d = parts(destination)
    if ".." in d:
        raise ValueError(f"{destination} has a parent step")
    for s in sources:
        if d[: len(parts(s))] == parts(s):
            raise ValueError(f"{destination} lies inside the source {s}")
    allowed = [parts(r) for r in roots]
    if allowed and not any(d[: len(r)] == r for r in allowed):
        raise ValueError(f"{destination} lies outside the allowed folders")
    return destination


def write_new(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Writes a result; refuses to start if something is left at the path."""
    df.write.format(form).mode("errorifexists").save(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
