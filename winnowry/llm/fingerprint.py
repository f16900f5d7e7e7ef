"""Document fingerprints from prefix polynomial hashes.

``Prefix`` holds modular prefix arrays of a text: the hash of any span is one difference
and one product, equal spans have equal hashes, and the longest common extension of two
places is found by binary search.  A fingerprint is made of span hashes: that of the whole
text, and the smallest hash of the 8-character spans in each of 64 buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import mix

SPAN = 8
BUCKETS = 64
_P = np.uint64(2**31 - 1)
_BASES = (1_103_515_245, 1_812_433_253)
_U31 = np.uint64(31)
_tables: dict[int, np.ndarray] = {}


def _fold(x: np.ndarray) -> np.ndarray:
    """x mod 2**31 - 1 for x below 2**62, with the multiple of the modulus left as it is."""
    x = (x & _P) + (x >> _U31)
    x = (x & _P) + (x >> _U31)
    return np.where(x >= _P, x - _P, x)


def _powers(base: int, n: int) -> np.ndarray:
    t = _tables.get(base)
    if t is None or len(t) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        t = np.ones(size, np.uint64)
        k = 1
        while k < size:
            t[k : 2 * k] = _fold(t[:k] * np.uint64(pow(base, k, int(_P))))
            k *= 2
        _tables[base] = t
    return t[:n]


class Prefix:
    """Prefix arrays of a sequence of code points under two bases modulo 2**31 - 1."""

    def __init__(self, points: np.ndarray) -> None:
        n = len(points)
        self.n = n
        self.sums, self.back = [], []
        for base in _BASES:
            s = np.zeros(n + 1, np.uint64)
            np.cumsum(_fold((points.astype(np.uint64) + np.uint64(1)) * _powers(base, n)), out=s[1:])
            self.sums.append(_fold(s))
            self.back.append(_powers(pow(base, -1, int(_P)), n + 1))

    def windows(self, k: int) -> np.ndarray:
        """62-bit hashes of all spans of k characters."""
        a, b = (_fold(_fold(s[k:] + _P - s[:-k]) * back[: len(s) - k]) for s, back in zip(self.sums, self.back, strict=True))
        return (a << _U31) | b

    def parts(self, i: int, j: int) -> list[int]:
        p = int(_P)
        return [(int(s[j]) - int(s[i])) * int(back[i]) % p for s, back in zip(self.sums, self.back, strict=True)]

    def span(self, i: int, j: int) -> int:
        """62-bit hash of the span [i, j)."""
        a, b = self.parts(i, j)
        return a << 31 | b

    def common(self, i: int, other: Prefix, j: int) -> int:
        """Length of the longest common extension of place i here and place j there."""
        lo, hi = 0, min(self.n - i, other.n - j)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                lo = mid
            else:
                hi = mid - 1
        return lo


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_EMPTY = np.uint64(2**64 - 1)


def _registers(h: np.ndarray) -> np.ndarray:
    """The smallest mixed span hash of each bucket."""
    reg = np.full(BUCKETS, _EMPTY, np.uint64)
    np.minimum.at(reg, (h >> np.uint64(58)).astype(np.int64), h)
    return reg


def _hashes(p: Prefix) -> np.ndarray:
    if p.n >= SPAN:
        return mix(p.windows(SPAN))
    return mix(np.array([p.span(0, p.n)], np.uint64)) if p.n else np.zeros(0, np.uint64)


def _written(whole: int, reg: np.ndarray) -> str:
    """Whole-text hash and bucket minima as lowercase hex; a bucket without spans is ffff."""
    low = np.where(reg == _EMPTY, np.uint64(0xFFFF), (mix(reg) >> np.uint64(16)) % np.uint64(0xFFFF))
    return f"{whole:016x}" + low.astype(">u2").tobytes().hex()


def _print(p: Prefix) -> str:
    return _written(p.span(0, p.n) if p.n else 0, _registers(_hashes(p)))


def _both(p: Prefix, keep: int, tail: np.ndarray) -> tuple[str, str, int]:
    """Fingerprints of a text and of its first ``keep`` characters with another tail, and their common prefix.

    Spans inside the kept part are hashed once; the edited text's own hash is put together from
    the hashes of its two parts.
    """
    if keep < SPAN:
        raise ValueError("too short to share spans")
    h = _hashes(p)
    inside, rest = _registers(h[: keep - SPAN + 1]), _registers(h[keep - SPAN + 1 :])
    q = Prefix(tail)
    edge = SPAN - 1  # the tail begins with the last kept characters
    new = _registers(_hashes(q)) if q.n >= SPAN else np.full(BUCKETS, _EMPTY, np.uint64)
    whole = 0
    for base, x, y in zip(_BASES, p.parts(0, keep), q.parts(edge, q.n), strict=True):
        whole = whole << 31 | (x + pow(base, keep, int(_P)) * y) % int(_P)
    own = _written(p.span(0, p.n), np.minimum(inside, rest))
    return own, _written(whole, np.minimum(inside, new)), keep + p.common(keep, q, edge)


def fingerprint(text: str) -> str:
    return _print(Prefix(points(text)))


def likeness(a: str, b: str) -> float:
    """Estimated share of common spans (Dice) of two fingerprints; 1 for equal ones, 0 if nothing is shared."""
    if a == b:
        return 1.0
    x = np.frombuffer(bytes.fromhex(a[16:]), ">u2")
    y = np.frombuffer(bytes.fromhex(b[16:]), ">u2")
    used = (x != 0xFFFF) | (y != 0xFFFF)
    if not used.any():
        return 0.0
    j = float((used & (x == y)).sum() / used.sum())
    return 2 * j / (1 + j)


_FIELDS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_prefix long"
)
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the row after it in the same range; the last row of a range is only looked at.

    A row's likeness to the next text waits until that text's fingerprint is made in its turn.
    """
    held: tuple | None = None  # bucket, doc, text, code points
    waits: list | None = None  # the row before ``held``, without its likeness to it
    rows: list[list] = []

    def settle(f: str) -> None:
        if waits is not None:
            waits[6] = likeness(waits[3], f)
            rows.append(waits)

    def batch_of() -> pa.RecordBatch:
        cols = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=[x.split()[0] for x in _FIELDS.split(", ")])

    for batch in batches:
        for bucket, doc, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc", "text")), strict=True):
            text = text or ""
            now = (bucket, doc, text, points(text))
            if held is not None and held[0] == bucket:
                _, d, t, cp = held
                half = len(t) // 2
                keep = len(t) - half
                edited = t[:keep] + text[:half]
                p = Prefix(cp)
                if keep >= SPAN:
                    f, g, same = _both(p, keep, np.concatenate([cp[keep - SPAN + 1 : keep], now[3][:half]]))
                else:
                    q = Prefix(points(edited))
                    f, g, same = _print(p), _print(q), p.common(0, q, 0)
                settle(f)
                waits = [d, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), f, g, likeness(f, g), None, same]
            elif held is not None:
                settle(_print(Prefix(held[3])))
                waits = None
            held = now
            if len(rows) >= 1000:
                yield batch_of()
                rows.clear()
    if held is not None:
        settle(_print(Prefix(held[3])))
    if rows:
        yield batch_of()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness; see ``_FIELDS``.

    Documents follow each other by descending id (null last, ties by a hash of the text), the
    last by the first.  The edited text has the last floor(n/2) characters replaced by the first
    as many of the next document.  Rows are dealt into ranges of ids; the first row of each range
    is sent to the range before it as well, so each task sees its own rows and one more.

    Defined cases: null text counts as empty; a single document is followed by itself; empty
    texts are like each other; rows with equal ids each get a row; no rows give no rows.
    """
    spark = docs.sparkSession
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    low = -(2**63)
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).select(
        "doc", "text", F.coalesce("doc", F.lit(low)).alias("key"), F.xxhash64("text").alias("tie")
    )
    ids = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("key"))
    cuts = ids.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(int(c)) for c in sorted(set(cuts))]).cast("array<long>")
    own = own.withColumn("bucket", F.size(F.filter(bounds, lambda b: b > F.col("key"))))
    # one row for each range: at most ``parts`` rows
    heads = sorted(own.groupBy("bucket").agg(F.max(F.struct("key", "tie")).alias("h")).collect(), key=lambda r: r["bucket"])
    if not heads:
        return spark.createDataFrame([], _FIELDS)
    before = {r["bucket"]: heads[i - 1]["bucket"] for i, r in enumerate(heads)}
    small = spark.createDataFrame(
        [(r["bucket"], r["h"]["key"], r["h"]["tie"], before[r["bucket"]]) for r in heads], "bucket int, key long, tie long, prior int"
    )
    ghosts = own.join(F.broadcast(small), ["bucket", "key", "tie"]).dropDuplicates(["bucket"]).select("doc", "text", "key", "tie", F.col("prior").alias("bucket"), F.lit(1).alias("ghost"))
    rows = own.select("doc", "text", "key", "tie", "bucket", F.lit(0).alias("ghost")).unionByName(ghosts)
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "ghost", F.desc("key"), F.desc("tie"))
    return rows.select("bucket", "doc", "text").mapInArrow(_compare, _FIELDS)
