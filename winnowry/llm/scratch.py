"""Intermediate tables in the folder that the cluster shares.

Lineage is cut by writing a Parquet table under ``spark.checkpoint.dir`` and
reading it back, so a lost executor costs a re-read and never a recomputation
of the job.  The folder is read from the session; a local one is set only where
the session names none (tests, notebooks).
"""

from __future__ import annotations

import atexit
import gc
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


class Scratch:
    """Tables of one operator call, in a folder of their own.

    ``keep`` writes a table and returns it re-read; ``keep_by`` writes it in buckets of a
    column, so that later joins on that column leave it where it is; ``drop`` deletes one that no
    later step reads.  What is left is deleted when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/winnowry/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._delete, self.folder, True)

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.folder}/{self._n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._scratch_path = path
        return back

    def keep_by(self, df: DataFrame, column: str, name: str = "t") -> DataFrame:
        self._n += 1
        path, table = f"{self.folder}/{self._n:03d}-{name}", f"winnowry_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(buckets, column).options(path=path, compression="lz4").saveAsTable(table)
        back = self.spark.table(table)
        back._scratch_path, back._scratch_table = path, table
        return back

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if getattr(t, "_scratch_table", None):
                self.spark.sql(f"DROP TABLE IF EXISTS {t._scratch_table}")
            if path:
                self._delete(path)

    def release(self) -> None:
        """Let Spark's cleaner remove shuffle files of plans that nothing refers to any more; worth it after large shuffles."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str, at_exit: bool = False) -> None:
        try:
            sc = self.spark.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone when the interpreter ends
            if not at_exit:
                raise


def is_empty(df: DataFrame) -> bool:
    """Whether a stored table has no row (reads one row at most)."""
    return not df.take(1)
