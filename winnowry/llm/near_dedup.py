"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct k-word shingles.  Its sketch has 256 registers; each
holds, for the smallest hash of its bucket, the count of leading zeros and ten mantissa
bits.  Empty registers are filled from others in a fixed order, so that short texts
compare as well.  Bands hash as many registers each as
lose at most one in ten thousand pairs at the threshold; together they cover all registers.  Sets of at most twenty shingles meet
by exact keys of their smallest shingles instead.  Pairs that share a band are kept if
the sizes allow a link and if the share of equal registers, on four bits each, among those that are filled in
one of both, corrected for chance collisions, is not far below the threshold; then the full sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash as W
from .linking import few_bits_apart, link, shared_members
from .packed import column
from .scratch import Scratch

REGISTERS = 256
LOSS = 1e-4
MANTISSA = 10
SHORT = 20
MARGIN = 0.12
_COMMON = 3
_WORDS = 32
_DEVIATIONS = 5
_rng = np.random.default_rng(7)
_SALTS = (np.uint64(0), np.uint64(0xA0761D6478BD642F))
_DETOUR = np.array([_rng.permutation(REGISTERS) for _ in range(64)])


def registers(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Registers of each set, (leading zeros + 1) << 10 | mantissa: with empty ones filled from others, and as they are (0: empty)."""
    low = np.zeros((len(sets), REGISTERS), np.uint64)
    have = np.zeros((len(sets), REGISTERS), bool)
    for d, u in enumerate(sets):
        b = (u >> np.uint64(56)).astype(np.int64)  # sorted as u is: the first of a bucket is its minimum
        new = np.flatnonzero(np.diff(b, prepend=-1))
        low[d, b[new]] = u[new] << np.uint64(8)
        have[d, b[new]] = True
    _, exp = np.frexp((low >> np.uint64(12)).astype(np.float64))
    zeros = (52 - exp).clip(0, 52).astype(np.uint64)
    mantissa = (low << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
    reg = (((zeros + np.uint64(1)) << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    reg[~have] = 0
    full = reg.copy()
    d, j = np.nonzero(~have & have.any(axis=1)[:, None])
    step = 0
    while len(d):
        turn = (_DETOUR[step % 64][j] + 67 * (step // 64)) % REGISTERS
        ok = have[d, turn]
        full[d[ok], j[ok]] = reg[d[ok], turn[ok]]
        d, j = d[~ok], j[~ok]
        step += 1
    return full, reg


def rows_of_bands(percent: int) -> int:
    """Most registers a band may have for pairs at the threshold to share no band in LOSS of cases at most."""
    p = percent / 100
    return max((r for r in range(1, 17) if (1 - p**r) ** (REGISTERS // r) <= LOSS), default=1)


def band_keys(reg: np.ndarray, percent: int) -> np.ndarray:
    """Signed 64-bit key of each band."""
    rows = rows_of_bands(percent)
    n = REGISTERS // rows
    of = reg[:, : n * rows].astype(np.uint64).reshape(len(reg), n, rows)
    out = np.broadcast_to(np.arange(1, n + 1, dtype=np.uint64), (len(reg), n))
    for j in range(rows):
        out = W.mix(out * np.uint64(0x9FB21C651E98DF25) + of[:, :, j])
    return out.view(np.int64)


def smallest_linked(percent: int) -> float:
    """Sets of fewer shingles are linked with equal sets only: n of n + 1 is below the threshold."""
    return -(-percent // (100 - percent)) if percent < 100 else np.inf


@cache
def _choices(n: int, t: int) -> np.ndarray:
    return np.array(list(combinations(range(n), t)), np.int64).reshape(-1, t)


def short_keys(u: np.ndarray, percent: int) -> np.ndarray:
    """Signed keys that two linked sets of at most SHORT shingles always share.

    The t smallest common shingles of a linked pair are among the first n - ceil(n * percent / 100) + t
    of each set, so a key for every choice of t among these loses no pair.  Linked sets that differ
    have ``smallest_linked`` common shingles at least.
    """
    t = min(_COMMON, int(smallest_linked(percent)))
    at = _choices(len(u) - -(-len(u) * percent // 100) + t, t)
    out = np.full(len(at), 0x5851F42D4C957F2D, np.uint64)
    for j in range(t):
        out = W.mix(out * np.uint64(0x9FB21C651E98DF25) + u[at[:, j]])
    return out.view(np.int64)


def _keys(u: np.ndarray, bands: np.ndarray, percent: int) -> list[int]:
    """Keys by which a set meets others: exact ones up to SHORT shingles, bands for all that may link with a larger set."""
    n = len(u)
    if n < smallest_linked(percent):
        return []
    exact = short_keys(u, percent).tolist() if n <= SHORT else []
    return exact + (bands.tolist() if n * 100 > SHORT * percent else [])


def packed(reg: np.ndarray) -> np.ndarray:
    """The registers on four bits, sixteen to a signed 64-bit value; 0 where a register is empty."""
    four = np.where(reg > 0, reg % 15 + 1, 0).astype(np.uint64).reshape(len(reg), -1, 16)
    return (four << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64).view(np.int64)


def _sketch(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.utf8(batch.column("text"))
            for i, j in W.slices(at):
                sets = W.shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], k)
                reg, own = registers(sets)
                size = np.array([len(s) for s in sets], np.int64)
                ident = [[W.mix(s + salt).sum(dtype=np.uint64) ^ np.uint64(len(s)) for s in sets] for salt in _SALTS]
                one, two = (W.mix(np.array(x, np.uint64)).view(np.int64) for x in ident)
                keys, four = band_keys(reg, percent), packed(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").slice(i, j - i),
                        batch.column("check").slice(i, j - i),
                        pa.array(size),
                        pa.array(one),
                        pa.array(two),
                        pa.array([_keys(u, x, percent) for u, x in zip(sets, keys, strict=True)], pa.list_(pa.int64())),
                        *[pa.array(np.ascontiguousarray(four[:, c])) for c in range(REGISTERS // 16)],
                    ],
                    names=["doc", "check", "n", "cid", "cid2", "keys", *[f"q{c}" for c in range(REGISTERS // 16)]],
                )

    return run


def _bit_sets(k: int):
    """2,048 bits set by the shingles of each text, as _WORDS columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = W.utf8(batch.column("text"))
            for i, j in W.slices(at):
                bits = np.zeros((j - i, 64 * _WORDS), bool)
                for d, u in enumerate(W.shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], k)):
                    bits[d, (u & np.uint64(64 * _WORDS - 1)).astype(np.int64)] = True
                words = np.packbits(bits, axis=1, bitorder="little").view(np.int64)
                columns = [pa.array(np.ascontiguousarray(words[:, w])) for w in range(_WORDS)]
                ones = pa.array(bits.sum(axis=1).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, j - i), ones, *columns], names=["id", "ones", *[f"w{w}" for w in range(_WORDS)]])

    return run


def _verified(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            da, aa = W.utf8(batch.column("ta"))
            db, ab = W.utf8(batch.column("tb"))
            for i, j in W.slices(aa + ab):
                left = W.shingle_sets(da[aa[i] : aa[j]], aa[i : j + 1] - aa[i], k)
                right = W.shingle_sets(db[ab[i] : ab[j]], ab[i : j + 1] - ab[i], k)
                for r, (x, y) in enumerate(zip(left, right, strict=True), i):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep[r] = common * 100 >= percent * (len(x) + len(y) - common) and common > 0
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _likely(percent: int):
    def filled(x: Column) -> Column:
        for n in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, n))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    # equal by chance: 1/15; MARGIN is five standard deviations of the estimate or more
    apart = 1 - ((percent / 100 - MARGIN) * 14 / 15 + 1 / 15)

    def cond(left, right) -> Column:
        n, m = left("n"), right("n")
        quads = [(left(f"q{c}"), right(f"q{c}")) for c in range(REGISTERS // 16)]
        unlike = sum((filled(x.bitwiseXOR(y)) for x, y in quads), F.lit(0))
        either = sum((filled(x.bitwiseOR(y)) for x, y in quads), F.lit(0))
        # short sets meet by exact keys and are not estimated
        near = (F.least(n, m) <= SHORT) | (unlike <= either * F.lit(apart))
        return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & near

    return cond


def near_groups(
    docs: DataFrame, store: Scratch, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80
) -> DataFrame:
    """Rows (doc, check, n, component): shingle count and smallest reachable id of each row.

    Documents are linked if 100 * intersection >= percent * union of their k-word shingle
    sets; a document with fewer words has the whole sequence as its one shingle; one without
    words has none and is linked with nothing.  Documents with equal sets form a class before
    banding, so exact copies never meet as pairs.  check is a hash of the text.

    Defined cases: null, empty and wordless texts have n 0 and component their own id; a null id
    is kept as null and is never a component's smallest id unless the group has no other (then
    component is null); repeated rows come out as often as they went in; no rows give no rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("check"), F.col(text_col).alias("text"))
    quads = [f"q{c}" for c in range(REGISTERS // 16)]
    schema = "doc long, check long, n long, cid long, cid2 long, keys array<long>, " + ", ".join(f"{q} long" for q in quads)
    sigs = store.keep(own.mapInArrow(_sketch(k, percent), schema), "sketches")
    reps = (
        sigs.where("n > 0")
        .groupBy("cid", "cid2")
        .agg(F.min_by(F.struct("doc", "check", "n", "keys", *quads), F.struct("doc", "check")).alias("r"), F.min("doc").alias("lo"))
    )
    # different sets under one first hash get ids of both hashes
    alone = F.count("*").over(Window.partitionBy("cid")) == 1
    reps = store.keep(reps.select(F.when(alone, F.col("cid")).otherwise(F.xxhash64("cid", "cid2")).alias("id"), "cid", "cid2", "lo", "r.*"), "classes")
    shared = shared_members(reps.select(F.explode("keys").alias("key"), "id"), store)
    facts = reps.join(shared.select("id").distinct(), "id", "left_semi").select("id", "doc", "check", "n", *quads)
    facts = store.keep(facts, "facts")
    wanted = facts.select("id", "doc", "check")
    texts = store.keep_by(
        own.join(wanted.hint("shuffle_hash"), [own["doc"].eqNullSafe(wanted["doc"]), own["check"] == wanted["check"]])
        .select("id", "text")
        .dropDuplicates(["id"]),
        "id",
        "texts",
    )

    def verify(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        b = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
        return pairs.join(a, "a").join(b, "b").mapInArrow(_verified(k, percent), "a long, b long")

    bits = store.keep_by(texts.mapInArrow(_bit_sets(k), "id long, ones long, " + ", ".join(f"w{w} long" for w in range(_WORDS))), "id", "bits")
    labels, _ = link(shared, verify, store, facts=facts.drop("doc", "check"), likely=_likely(percent), more=bits, sharp=few_bits_apart(_WORDS, percent, _DEVIATIONS))
    to = reps.select("id", "cid", "cid2", "lo").join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    best = to.groupBy("comp").agg(F.min("lo").alias("component"))
    to = to.join(best, "comp").select("cid", "cid2", "component")
    base = sigs.select("doc", "check", "n", "cid", "cid2")
    out = store.keep(
        base.join(to, ["cid", "cid2"], "left").select(
            "doc", "check", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc")).alias("component")
        ),
        "groups",
    )
    store.drop(sigs, reps, shared, facts, texts, bits, labels)
    return out


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near duplicates: of each group the one with the smallest id stays.

    Defined cases: null, empty and wordless texts are linked with nothing and stay; of rows
    that share the smallest id of a group, all stay; a document with words and a null id stays
    only if it has no near duplicate with an id; no rows give no rows; all columns pass through.
    """
    store = Scratch(docs.sparkSession, "near")
    groups = near_groups(docs, store, id_col, text_col, k, percent)
    gone = groups.where("n > 0 AND component IS NOT NULL AND (doc IS NULL OR doc <> component)").select("doc", "check").distinct()
    gone = store.keep(gone, "gone")
    whole = docs.select(F.struct(*[column(c).alias(c) for c in docs.columns]).alias("_row"), F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_check"))
    left = whole.join(
        gone.hint("shuffle_hash"), whole["_id"].eqNullSafe(gone["doc"]) & (whole["_check"] == gone["check"]), "left_anti"
    )
    return left.select(*[F.col(f"_row.`{c}`") for c in docs.columns])
