"""Columns added by Arrow functions, whatever the other columns are called."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def column(name: str) -> Column:
    """A top-level column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def give_back() -> None:
    """Returns memory that the driver's Python no longer uses, as after a fit; an allocator may keep it, and the steps that follow need it."""
    gc.collect()
    trim()


def trim() -> None:
    """Free memory goes from the allocators back to the system; a worker's peak is then that of one slice, not of all before."""
    pa.default_memory_pool().release_unused()
    malloc_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if malloc_trim is not None:  # glibc only
        malloc_trim(0)


#: The default size of a row group, which is what one task reads at least.
ROW_GROUP = 128 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a small input dealt over all cores; others as they are.

    A table of fewer files than cores and less than a row group a core may be read by fewer tasks than there are cores, and
    Python work is worth the shuffle of so little.  A larger one is read by all cores, and is never shuffled.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) >= cores * ROW_GROUP:
        return rows
    files = len(rows.inputFiles())
    return rows.repartition(cores) if 0 < files < cores else rows


def with_columns(
    rows: DataFrame, reads: str, adds: str, fill: Callable[[pa.Array], Iterator[tuple[int, list[pa.Array]]]]
) -> DataFrame:
    """Adds the columns of the DDL string ``adds``; input columns named like them are replaced.

    ``fill`` gets the values of column ``reads`` of a batch and yields, in order, how many rows come
    next and their added columns.  All other columns travel as one struct, so no name can clash, and the
    column that is read travels once.
    """
    new = StructType.fromDDL(adds)
    keep = [c for c in rows.columns if c not in new.names]
    others = [c for c in keep if c != reads]
    row = F.struct(F.lit(0).alias("_"), *[column(c).alias(f"c{i}") for i, c in enumerate(others)]).alias("row")
    src = rows.select(row, column(reads).alias("value"))
    back = [src.schema["row"], *([src.schema["value"]] if reads in keep else [])]
    schema = StructType([*back, *[StructField(f"a{i}", f.dataType) for i, f in enumerate(new.fields)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for n, columns in fill(batch.column("value")):
                same = [batch.column(f.name).slice(at, n) for f in back]
                yield pa.RecordBatch.from_arrays([*same, *columns], names=schema.names)
                at += n

    out = spread(src).mapInArrow(run, schema)
    of = {c: F.col(f"row.c{i}") for i, c in enumerate(others)} | {reads: F.col("value")}
    return out.select(*[of[c].alias(c) for c in keep], *[F.col(f"a{i}").alias(n) for i, n in enumerate(new.names)])
