"""A sink of parts: a stream's batches are kept one by one and become the result when the stream has ended.

Beside the result ``out`` there is a folder ``out``.parts with one part for each micro-batch, written whole or written again,
so a batch that ran twice counts once.  The result is written under another name and renamed; then the parts go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

_OWNER = "owner.txt"


class Cancelled(Exception):
    """A stream was asked to stop; its last batch is not committed and comes again."""


class PartSink:
    """Writes a stream as JSON lines to ``out``, resumable from its checkpoint.

    Another run's leftovers are never continued or overwritten: parts that belong to another checkpoint, parts without a
    checkpoint, or a result that exists already are errors before anything runs.
    """

    def __init__(self, spark: SparkSession, out: str, checkpoint: str) -> None:
        self.spark, self.out, self.checkpoint = spark, out.rstrip("/"), checkpoint.rstrip("/")
        self.parts = f"{self.out}.parts"

    def _path(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._path(path)
        return fs.exists(p)

    def _delete(self, path: str) -> None:
        fs, p = self._path(path)
        fs.delete(p, True)

    def _owner(self) -> str | None:
        if not self._exists(f"{self.parts}/{_OWNER}"):
            return None
        return self.spark.read.text(f"{self.parts}/{_OWNER}").first()[0]

    def check(self) -> None:
        """Raises if something is left that is not this run's own."""
        if self._exists(self.out):
            raise FileExistsError(f"{self.out} exists already")
        if self._exists(self.parts):
            if self._owner() != self.checkpoint or not self._exists(f"{self.checkpoint}/offsets"):
                raise FileExistsError(f"{self.parts} was left by another run; put it away first")
        elif self._exists(f"{self.checkpoint}/commits"):
            raise FileExistsError(f"{self.checkpoint} belongs to a run whose parts are gone")

    def write_batch(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{self.parts}/batch={number}")

    def start(self, stream: DataFrame, cancelled: Callable[[], bool] = lambda: False) -> StreamingQuery:
        """Starts or resumes; ``cancelled`` is asked before every batch."""
        self.check()
        if not self._exists(self.parts):
            fs, p = self._path(f"{self.parts}/{_OWNER}")
            f = fs.create(p)
            f.write(bytearray(self.checkpoint.encode()))
            f.close()

        def handle(batch: DataFrame, number: int) -> None:
            if cancelled():
                raise Cancelled(f"before batch {number}")
            self.write_batch(batch, number)

        return stream.writeStream.foreachBatch(handle).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()

    def rows(self, schema) -> DataFrame:
        """What the parts hold."""
        return self.spark.read.schema(schema).json(f"{self.parts}/batch=*")

    def finish(self, schema) -> None:
        """Makes the result out of the parts, then deletes them; may be called again after a crash."""
        if not self._exists(self.out):
            self.rows(schema).write.mode("overwrite").json(f"{self.out}.new")
            fs, new = self._path(f"{self.out}.new")
            if not fs.rename(new, self._path(self.out)[1]):
                raise OSError(f"{self.out}.new could not be renamed")
        self._delete(self.parts)

    def run(self, stream: DataFrame, cancelled: Callable[[], bool] = lambda: False) -> bool:
        """Start, wait, finish; False if it was cancelled, and then the same call goes on where it stopped."""
        try:
            self.start(stream, cancelled).awaitTermination()
        except StreamingQueryException as e:
            if "Cancelled" in str(e):
                return False
            raise
        self.finish(stream.schema)
        return True
