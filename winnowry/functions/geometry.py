"""Rectangles [x, y, w, h], rasters, hashes and eye shapes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where it is used inside lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def area(r: Column) -> Column:
    return r[2] * r[3]


def overlap(a: Column, b: Column) -> Column:
    """Area of the intersection of two rectangles."""
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def overlap_share(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 if that area is 0."""
    small = F.least(area(a), area(b))
    return F.when(small > 0, overlap(a, b) / small).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    inter = overlap(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def normal_box(r: Column) -> Column:
    """A box in units of 1, 100 or 1000, judged by its largest number, scaled to 1."""
    top = F.array_max(r)
    scale = F.when(top > 100, 1000.0).when(top > 1, 100.0).otherwise(1.0)
    return F.transform(r, lambda v: v / scale)


def crop(box: Column, pad: float, width: Column, height: Column) -> Column:
    """Pixel rectangle of a bottom-left unit box, padded outward by a share of its size, top-left origin."""
    x0, x1 = box[0] - box[2] * pad, box[0] + box[2] * (1 + pad)
    y0, y1 = 1 - (box[1] + box[3] * (1 + pad)), 1 - (box[1] - box[3] * pad)
    low = lambda v, n: F.greatest(F.lit(0), F.floor(v * n)).cast("long")
    high = lambda v, n: F.least(n.cast("long"), F.ceil(v * n).cast("long"))
    return F.array(low(x0, width), low(y0, height), high(x1, width), high(y1, height))


def eye_openness(eyes: Column) -> Column:
    """Mean height / width of eye outlines (arrays of {x, y}) with four points or more and some width; else null."""
    span = lambda e, k: F.array_max(F.transform(e, lambda p: p[k])) - F.array_min(F.transform(e, lambda p: p[k]))
    ok = F.filter(eyes, lambda e: (F.size(e) >= 4) & (span(e, "x") > 0))
    ratio = F.transform(ok, lambda e: span(e, "y") / span(e, "x"))
    return F.when(F.size(ratio) > 0, F.aggregate(ratio, F.lit(0.0), lambda s, v: s + v) / F.size(ratio))


def raster(values: Column) -> Column:
    """A vector as grey levels 0..255: floor((v - min) / (max - min) * 255); a flat one is all 0."""

    def scaled(x: Column) -> Column:
        ends = F.struct(F.array_min(x).alias("lo"), F.array_max(x).alias("hi"))
        return let(ends, lambda m: F.transform(x, lambda v: level(v, m)))

    def level(v: Column, m: Column) -> Column:
        return F.when(m["hi"] > m["lo"], F.floor((v - m["lo"]) / (m["hi"] - m["lo"]) * 255)).otherwise(0).cast("int")

    return let(values, scaled)


def block_hash(cells: Column) -> Column:
    """64 cells against their integer mean, the first cell in the highest bit."""
    mean = lambda c: F.floor(F.aggregate(c, F.lit(0), lambda s, v: s + v) / 64).cast("int")
    add = lambda s, v, m: F.shiftleft(s, 1).bitwiseOR(F.when(v >= m, 1).otherwise(0).cast("long"))
    fold = lambda c, m: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: add(s, v, m))
    return let(cells, lambda c: let(mean(c), lambda m: fold(c, m)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_duplicate(a: Column, b: Column, light_a: Column, light_b: Column, bits: int, light: int) -> Column:
    return (F.abs(light_a - light_b) <= light) & (hamming(a, b) <= bits)


def sharpness(px: Column, side: int = 8) -> Column:
    """Mean of the strongest max(8, 1 %) four-neighbour Laplacian magnitudes over max(8, range), inner pixels."""
    inner = [(y, x) for y in range(1, side - 1) for x in range(1, side - 1)]
    at = F.array(*[F.lit(y * side + x) for y, x in inner])
    mags = let(px, lambda p: F.transform(at, lambda i: F.abs(p[i] * 4 - p[i - 1] - p[i + 1] - p[i - side] - p[i + side])))
    n = max(8, len(inner) // 100)
    top = F.slice(F.sort_array(mags, asc=False), 1, n)
    mean = F.aggregate(top, F.lit(0), lambda s, v: s + v) / n
    return mean / F.greatest(F.lit(8), F.array_max(px) - F.array_min(px))


def exposure(px: Column) -> tuple[Column, Column, Column]:
    """Shares of pixels at most 8 and at least 247, and the risks found, each on its own."""
    n = F.size(px)
    dark = F.size(F.filter(px, lambda v: v <= 8)) / n
    light = F.size(F.filter(px, lambda v: v >= 247)) / n
    risks = F.filter(
        F.array(
            F.when(F.array_max(px) - F.array_min(px) < 28, F.lit("low_contrast")),
            F.when(dark >= 0.35, F.lit("shadow_clipping")),
            F.when(light >= 0.35, F.lit("highlight_clipping")),
        ),
        lambda r: r.isNotNull(),
    )
    return dark, light, risks


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
