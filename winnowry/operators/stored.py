"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session; a local session that names none gets a temporary one, a cluster an error."""
    folder = spark.conf.get(_CONF, None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{_CONF} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="winnowry-")
        spark.conf.set(_CONF, folder)
    return folder.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone when the interpreter ends
        return


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read again: a lost executor costs a re-read.

    The table is deleted by ``dropped``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/winnowry/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_path = path
    return back


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that no later step reads."""
    for t in tables:
        if path := getattr(t, "_stored_path", None):
            _delete(t.sparkSession, path)
