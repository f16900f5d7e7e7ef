"""Nearest points in the plane, by tiles of equally many targets and boxes that cannot hold a nearer one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .ordering import numbered, numbered_in
from .stored import dropped, stored

_TILE = 2048
_TILES = 1024
_SLICE = 16384


def _tiled(spots: DataFrame, n: int) -> DataFrame:
    """(t, x, y, tile): targets in stripes by x, stripes in tiles by y; tiles hold equally many, however the targets lie."""
    count = max(1, min(_TILES, n // _TILE))
    stripes = max(1, round(count**0.5))
    tall = -(-count // stripes)
    striped = numbered(spots, [F.col("x"), F.col("y")], "_at").withColumn("_stripe", F.floor(F.col("_at") * stripes / n).cast("int")).drop("_at")
    placed = numbered_in(striped, ["_stripe"], [F.col("y"), F.col("x")], "_at", "_of")
    return stored(placed.select("t", "x", "y", (F.col("_stripe") * tall + F.floor(F.col("_at") * tall / F.col("_of"))).cast("int").alias("tile")))


def _beyond(boxes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box, never more than to a target in it, also as rounded."""
    dx = np.maximum(np.maximum(boxes[:, 1] - x[:, None], x[:, None] - boxes[:, 2]), 0)
    dy = np.maximum(np.maximum(boxes[:, 3] - y[:, None], y[:, None] - boxes[:, 4]), 0)
    return dx * dx + dy * dy


def _met(points: DataFrame, spots: DataFrame, schema: StructType) -> DataFrame:
    """(i, x, y, tile, d, t): for each point and tile it is dealt to, the nearest target there.

    A tile with many points is dealt out several times, to a slice of its points each, so no task gets all points of a tile.
    """
    size = points.groupBy("tile").agg(F.ceil(F.count("*") / _SLICE).cast("int").alias("slices"))
    size = stored(size)  # one row a tile
    cells = size.agg(F.sum("slices")).first()[0] or 1
    one = spots.join(F.broadcast(size), "tile").select("tile", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("side"), "t", F.lit(None).cast(schema["i"].dataType).alias("i"), "x", "y")
    two = points.join(F.broadcast(size), "tile").select("tile", F.pmod(F.xxhash64("i", "x", "y"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("side"), F.lit(None).cast(schema["t"].dataType).alias("t"), "i", "x", "y")
    # targets come in order of their ids, so of equal distances the first is the smallest
    dealt = one.unionByName(two).repartition(min(int(cells), 512), "tile", "slice").sortWithinPartitions("tile", "slice", "side", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, spot = None, [], None
        for batch in batches:
            key = [batch.column(c).to_numpy() for c in ("tile", "slice", "side")]
            cuts = np.flatnonzero(np.any([np.diff(k) != 0 for k in key], axis=0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                here = (int(key[0][lo]), int(key[1][lo]))
                if here != cell:
                    cell, held, spot = here, [], None
                if key[2][lo] == 0:
                    held.append(part.select(["t", "x", "y"]))
                    continue
                if spot is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    spot = table.column("t"), table.column("x").to_numpy(), table.column("y").to_numpy()
                t, tx, ty = spot
                px, py = part.column("x").to_numpy(), part.column("y").to_numpy()
                at, d = np.empty(len(px), np.int64), np.empty(len(px))
                step = max(1, 200_000 // len(tx))
                for k in range(0, len(px), step):
                    dx, dy = tx - px[k : k + step, None], ty - py[k : k + step, None]
                    dx *= dx
                    dy *= dy
                    dx += dy
                    at[k : k + step] = dx.argmin(axis=1)
                    d[k : k + step] = dx[np.arange(len(dx)), at[k : k + step]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("i"), part.column("x"), part.column("y"), part.column("tile"), pa.array(d), t.take(pa.array(at)).combine_chunks()], names=schema.names
                )

    return dealt.mapInArrow(run, schema)


def nearest_points(points: DataFrame, point: str, targets: DataFrame, target: str, x: str = "x", y: str = "y") -> DataFrame:
    """(point, target, distance2): for each point the target of the smallest squared distance, of equals the smallest.

    Targets are cut into tiles of equally many (1,024 tiles at most).  A point meets the targets of the tile whose box is nearest, then those of the other tiles whose
    boxes are no farther than what it found; far from all targets that are few as well.  Only a point about as far from very many tiles, as the
    centre of a ring, meets them all.  Targets at one place are one.

    Defined cases: points and targets without coordinates or id are left out; no targets give no rows.
    """
    whole = lambda d, i: d.select(F.col(i).alias("i"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("i IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    left = whole(points, point)
    spots = stored(whole(targets, target).groupBy("x", "y").agg(F.min("i").alias("t")))
    n = spots.count()
    if not n:
        kinds = f"{point} {points.schema[point].dataType.simpleString()}, {target} {targets.schema[target].dataType.simpleString()}, distance2 double"
        return points.sparkSession.createDataFrame([], kinds)
    tiled = _tiled(spots, n)
    dropped(spots)
    boxes = np.array([tuple(r) for r in tiled.groupBy("tile").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).collect()], dtype=np.float64)  # one row a tile
    dealt = StructType([StructField("i", points.schema[point].dataType), StructField("x", DoubleType()), StructField("y", DoubleType()), StructField("tile", IntegerType())])
    schema = StructType([*dealt.fields, StructField("d", DoubleType()), StructField("t", targets.schema[target].dataType)])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                yield part, _beyond(boxes, part.column("x").to_numpy(), part.column("y").to_numpy())

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, far in parts(batches):
            tile = boxes[far.argmin(axis=1), 0].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tile)], names=dealt.names)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, far in parts(batches):
            near = (far <= part.column("d").to_numpy()[:, None]) & (boxes[:, 0] != part.column("tile").to_numpy()[:, None])
            at, tile = np.nonzero(near)
            if len(at):
                took = part.select(["i", "x", "y"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(boxes[tile, 0].astype(np.int32))], names=dealt.names)

    near = stored(_met(stored(left.mapInArrow(first, dealt)), tiled, schema))
    far = stored(_met(stored(near.mapInArrow(others, dealt)), tiled, schema))
    best = near.unionByName(far).groupBy("i").agg(F.min(F.struct("d", "t")).alias("m"))
    return best.select(F.col("i").alias(point), F.col("m.t").alias(target), F.col("m.d").alias("distance2"))
