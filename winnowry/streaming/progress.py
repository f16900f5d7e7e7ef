"""Streams over growing logs; each gives the rows of its batch form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

CALL = T.StructType([T.StructField("cell", T.StringType()), T.StructField("pair", T.LongType()), T.StructField("ok", T.BooleanType()), T.StructField("ts", T.TimestampType())])


def progress(calls: DataFrame) -> DataFrame:
    """Calls, successes and last time of each cell; batch or stream."""
    return calls.groupBy("cell").agg(F.count("*").alias("done"), F.count_if("ok").alias("ok"), F.max("ts").alias("last"))


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, files: int = 32) -> StreamingQuery:
    """Progress of a folder of JSON lines into the memory table ``out``; half-written lines are dropped."""
    calls = spark.readStream.schema(CALL).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files).json(folder)
    return progress(calls).writeStream.outputMode("complete").format("memory").queryName(out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands micro-batches to a function; the batch number lets it skip one it has seen."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(calls: DataFrame, key: str, need: int) -> DataFrame:
    """Keys with ``need`` rows or more: what a resumed run may skip."""
    return calls.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= need).select(key)


def bursts(events: DataFrame, user: str, ts: str, gap_seconds: int) -> DataFrame:
    """Groups of events without a longer gap, by user: (user, start, end, n)."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(user).orderBy("t")
    x = events.select(user, t.alias("t")).withColumn("new", (F.col("t") - F.lag("t").over(w) > gap_seconds * 1_000_000).cast("int"))
    x = x.withColumn("b", F.sum(F.coalesce("new", F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(user, "b").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n")).drop("b")


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str, late: str) -> DataFrame:
    """Counts by event-time window and key; rows later than ``late`` are left out of closed windows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
