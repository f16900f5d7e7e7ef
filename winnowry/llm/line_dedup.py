"""Fuzzy line dedup with DataFrame functions only.

A line's set is its distinct character shingles.  Distinct lines come first, with their counts, in
buckets of their hash.  A line is then exploded into its shingles, each one slice of the
line's four-byte characters, and signed by sixteen MinHash values: value j is the smallest of
``hash XOR j``, j in the hash's first four bits, so each value comes from another part of the hashes.  Every
line is signed in the same way, as its length says nothing about how many distinct shingles it has; a
long line skips hashes that are too large to be the smallest of their part, and a line that then has
nothing in a part is signed once more on all its shingles, so the values are the same as without
skipping.  Twelve bands of three values name the candidates.  A pair goes on if its values, compared
on a byte each, are not far below the threshold, and if the bits set by the shingles of one line
only are no more than the threshold allows, with four standard deviations for chance.  Exact Jaccard decides.  Links become
components by distributed union-find, and one line of each component is kept.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linking import few_bits_apart, link, shared_members
from .packed import column
from .scratch import Scratch

SHINGLE = 8
PERCENT = 80
LOSS = 2e-3
_MINS = 16
_ENOUGH = 96
_WORDS = 32
_DEVIATIONS = 4
#: Triples of the sixteen values of which two have one in common at most.
BANDS = [
    (8, 14, 15), (4, 13, 14), (0, 6, 9), (1, 10, 13), (0, 8, 13), (2, 4, 7),
    (0, 2, 10), (3, 7, 12), (5, 9, 14), (1, 6, 11), (5, 12, 15), (3, 9, 11),
]


def _bytes(line: Column) -> Column:
    """Four bytes for each character, so that a shingle is a slice at a known place."""
    return F.encode(line, "utf-32")


def _last(data: Column, k: int) -> Column:
    return F.greatest((F.length(data) / 4).cast("int") - k, F.lit(0))


def _starts(data: Column, k: int) -> Column:
    return F.sequence(F.lit(0), _last(data, k))


def _hash_at(data: Column, i: Column, k: int) -> Column:
    return F.xxhash64(F.substring(data, i * 4 + 1, F.lit(4 * k)))


def _shingle_set(line: Column, k: int) -> Column:
    """Distinct 64-bit hashes of the k-character slices; a shorter line is one slice.

    The encoded line is a lambda's argument, so it is computed once for all slices.
    """
    one = F.transform(F.array(_bytes(line)), lambda d: F.array_distinct(F.transform(_starts(d, k), lambda i: _hash_at(d, i, k))))
    return F.element_at(one, 1)


def least_equal(percent: int) -> int:
    """Fewest equal values that pairs at the threshold have but for LOSS of cases."""
    p, below = percent / 100, 0.0
    for t in range(_MINS + 1):
        below += comb(_MINS, t) * p**t * (1 - p) ** (_MINS - t)
        if below > LOSS:
            return t
    return _MINS


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc, rid, line_no, line) of every non-blank line."""
    return (
        docs.select(
            F.col(id_col).alias("doc"),
            F.xxhash64(id_col, text_col).alias("rid"),
            F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"),
        )
        .where(F.length(F.trim("line")) > 0)
    )


def distinct_lines(docs: DataFrame, store: Scratch, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, line, c, first_doc) of every distinct line, in buckets of id.

    id is the line's 64-bit hash, c its number of rows, first_doc the smallest document that
    holds it.  Of two lines with one hash, neither is in.
    """
    check = F.xxhash64(F.lit(7), "line")
    lines = lines_of(docs, id_col, text_col).select("doc", F.xxhash64("line").alias("id"), check.alias("check"), "line")
    lines = lines.groupBy("id").agg(
        F.min("line").alias("line"), F.count("*").alias("c"), F.min("doc").alias("first_doc"),
        F.min("check").alias("c0"), F.max("check").alias("c1"),
    )
    return store.keep_by(lines.where("c0 = c1").drop("c0", "c1"), "id", "lines")


def _hashes(lines: DataFrame, shingle: int) -> DataFrame:
    """Rows (id, last, i, h) of every shingle; last is the place of the line's last one, i its own."""
    # The encoded line is a generator's output: an expression would be computed again for each slice.
    data = lines.select("id", F.explode(F.array(_bytes(F.col("line")))).alias("data"))
    at = data.select("id", "data", _last(F.col("data"), shingle).alias("last"), F.explode(_starts(F.col("data"), shingle)).alias("i"))
    return at.select("id", "last", "i", _hash_at(F.col("data"), F.col("i"), shingle).alias("h"))


def _signed(hashes: DataFrame) -> DataFrame:
    """Rows (id, last, m0..): the MinHash values of each line."""
    part = lambda j: (j << 60) - (1 << 64) * (j >= 8)
    mins = [F.min(F.col("h").bitwiseXOR(F.lit(part(j)))).alias(f"m{j}") for j in range(_MINS)]
    return hashes.groupBy("id").agg(F.max("last").alias("last"), *mins)


def _keyed(signed: DataFrame, *more: Column) -> DataFrame:
    """Rows (id, keys, q0, q1): what later steps read of the values, so that each reads only its part and none makes the keys again."""
    m = [F.col(f"m{j}") for j in range(_MINS)]
    low = [F.shiftleft(x.bitwiseAND(F.lit(255)), 8 * (j % 8)) for j, x in enumerate(m)]
    return signed.select(
        "id",
        *more,
        F.array(*[F.xxhash64(F.lit(b), *[m[j] for j in js]) for b, js in enumerate(BANDS)]).alias("keys"),
        *[sum(low[c + 1 : c + 8], low[c]).alias(f"q{c // 8}") for c in range(0, _MINS, 8)],
    )


def signatures(lines: DataFrame, store: Scratch, shingle: int) -> DataFrame:
    """Rows (id, keys, q0, q1) of every distinct line: keys of its bands and the low bytes of its values.

    ``_scratch_parts`` are the stored tables that the rows are read from.
    """
    all_ = _hashes(lines, shingle)
    small = (F.col("last") < _ENOUGH) | (F.shiftrightunsigned("h", 48).bitwiseAND(F.lit(4095)) * F.col("last") < _ENOUGH * 4096)
    # the first shingle of every line stays as a row, so that a line that keeps no hash is known
    some = all_.where(small | (F.col("i") == 0)).withColumn("h", F.when(small, F.col("h")))
    # values are signed: the smallest of their own part begin with the bits 1000, others come from another part
    bare = F.lit(False)
    for j in range(_MINS):
        bare |= F.shiftrightunsigned(F.coalesce(f"m{j}", F.lit(0)), 60) != 8
    bare &= F.col("last") >= _ENOUGH
    some = store.keep_by(_keyed(_signed(some), bare.alias("bare")), "id", "signatures")
    again = lines.join(some.where("bare").select("id").hint("shuffle_hash"), "id", "left_semi")
    rest = store.keep(_keyed(_signed(_hashes(again, shingle))), "again")
    signed = some.where("NOT bare").drop("bare").unionByName(rest)
    signed._scratch_parts = (some, rest)
    return signed


def bit_sets(lines: DataFrame, shingle: int) -> DataFrame:
    """Rows (id, n, ones, words): number of shingles of each line, repeats counted, and 2,048 bits set by their hashes, with their count."""
    h = _hashes(lines, shingle).select("id", "last", F.col("h").bitwiseAND(F.lit(_WORDS - 1)).alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 5) & 63 AS int))").alias("bit"))
    words = h.groupBy("id", "w").agg(F.max("last").alias("last"), F.bit_or("bit").alias("bits"))
    of = [F.coalesce(F.max(F.when(F.col("w") == w, F.col("bits"))), F.lit(0)) for w in range(_WORDS)]
    return words.groupBy("id").agg((F.max("last") + 1).cast("long").alias("n"), F.sum(F.bit_count("bits")).alias("ones"), F.array(*of).alias("words"))


def _likely(percent: int):
    def unlike(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for n in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, n))
        return F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))

    def cond(left, right) -> Column:
        return sum((unlike(left(f"q{c}"), right(f"q{c}")) for c in range(_MINS // 8)), F.lit(0)) <= _MINS - least_equal(percent)

    return cond


def line_components(
    docs: DataFrame,
    store: Scratch,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
) -> tuple[DataFrame, DataFrame]:
    """Components and distinct lines: (id, comp) of every line with a link to another, and ``distinct_lines`` without the texts."""
    lines = distinct_lines(docs, store, id_col, text_col)
    store.release()
    signed = signatures(lines, store, shingle)
    shared = shared_members(signed.select(F.explode("keys").alias("key"), "id"), store)
    # from here on only lines of shared buckets need their text and values
    held = store.keep_by(shared.select("id").distinct(), "id", "held")
    store.release()
    facts = store.keep_by(signed.drop("keys").join(held.hint("shuffle_hash"), "id", "left_semi"), "id", "facts")
    texts = store.keep_by(lines.join(held.hint("shuffle_hash"), "id", "left_semi").select("id", "line"), "id", "texts")
    known = store.keep_by(lines.drop("line"), "id", "known")
    store.drop(lines, *signed._scratch_parts, held)
    bits = store.keep_by(bit_sets(texts, shingle), "id", "bits")
    store.release()

    close_ = few_bits_apart(_WORDS, percent, _DEVIATIONS, packed=True)

    def verify(pairs: DataFrame) -> DataFrame:
        packed = bits.select("id", F.struct("n", "ones", "words").alias("bits"))
        left, right = (packed.select(F.col("id").alias(c), F.col("bits").alias(f"bits{c}")) for c in "ab")
        close = close_(lambda x: F.col(f"bitsa.{x}"), lambda x: F.col(f"bitsb.{x}"))
        pairs = pairs.join(left, "a").join(right, "b").where(close).select("a", "b")
        a = texts.select(F.col("id").alias("a"), F.col("line").alias("ta"))
        b = texts.select(F.col("id").alias("b"), F.col("line").alias("tb"))
        sets = (
            pairs.join(a, "a")
            .join(b, "b")
            .select("a", "b", _shingle_set(F.col("ta"), shingle).alias("sa"), _shingle_set(F.col("tb"), shingle).alias("sb"))
            .select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("inter"))
        )
        return sets.where(F.col("inter") * 100 >= (F.col("total") - F.col("inter")) * percent)

    labels, _ = link(shared, verify, store, facts=facts, likely=_likely(percent), more=bits, sharp=close_)
    store.drop(shared, facts, texts, bits)
    return labels, known


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """Documents with repeated lines removed from ``text_col``; all other columns stay.

    Lines are split at newlines.  Two lines are alike if they are equal or their sets of
    ``shingle``-character slices have a Jaccard similarity of ``percent`` or more; links
    are transitive.  Of each component the line in the smallest document id stays, there
    the first one.  Blank lines are never compared and stay, unless nothing else is left
    of the document.  Adds n_lines (non-blank lines before) and n_kept (after).

    Defined cases: null or empty text stays as it is with counts 0; a document of which
    every line repeats others keeps its row with empty text; rows that share an id and
    text are one document and keep the same lines; a null id sorts last; no rows give
    no rows; other columns pass through, whatever they are called, and an input column named
    like an added one is replaced.
    """
    spark = docs.sparkSession
    store = Scratch(spark, "lines")
    key = F.coalesce(F.col(id_col), F.lit(2**63 - 1))
    own = docs.select(key.alias("doc_id"), F.col(text_col).alias("text"))
    comps, lines = line_components(own, store, shingle=shingle, percent=percent)
    ids = lines.select("id", "c", "first_doc").join(comps, "id", "left").where("c > 1 OR comp IS NOT NULL")
    ids = ids.select("id", F.coalesce("comp", "id").alias("comp"), F.col("first_doc").alias("lo"))
    best = ids.groupBy("comp").agg(F.min("lo").alias("best"))
    ids = store.keep(ids.join(best, "comp").select("id", "comp", "best"), "repeats")
    store.drop(lines)
    found = lines_of(own, "doc_id", "text").select("doc", "rid", "line_no", F.xxhash64("line").alias("id"))
    hit = found.join(ids, "id").groupBy("doc", "rid", "comp", (F.col("doc") == F.col("best")).alias("mine")).agg(
        F.min("line_no").alias("lo"), F.collect_list("line_no").alias("at")
    )
    gone = hit.select(
        "doc", "rid", F.when(F.col("mine"), F.filter("at", lambda x: x != F.col("lo"))).otherwise(F.col("at")).alias("at")
    ).where(F.size("at") > 0)
    gone = gone.groupBy("doc", "rid").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("gone"))
    gone = store.keep(gone, "gone").select(F.col("doc").alias("_doc"), F.col("rid").alias("_rid"), F.col("gone").alias("_gone"))
    full = lambda xs: F.size(F.filter(xs, lambda x: F.length(F.trim(x)) > 0)).cast("long")
    added = ("n_lines", "n_kept")
    whole = docs.select(F.struct(*[column(c).alias(c) for c in docs.columns]).alias("_row"), key.alias("_doc"), F.xxhash64(key, F.col(text_col)).alias("_rid"))
    joined = whole.join(gone.hint("shuffle_hash"), ["_doc", "_rid"], "left")
    cut = (
        joined.withColumn("_text", F.col(f"_row.`{text_col}`"))
        .withColumn("_parts", F.coalesce(F.split("_text", "\n", -1), F.array().cast("array<string>")))
        .withColumn("_kept", F.when(F.col("_gone").isNull(), F.col("_parts")).otherwise(
            F.filter("_parts", lambda x, i: ~F.array_contains("_gone", i))))
        .withColumn("n_lines", full(F.col("_parts")))
        .withColumn("n_kept", full(F.col("_kept")))
    )
    text = (
        F.when(F.col("_gone").isNull(), F.col("_text"))
        .when(F.col("n_kept") == 0, F.lit(""))
        .otherwise(F.array_join("_kept", "\n"))
    )
    kept = [text.alias(c) if c == text_col else F.col(f"_row.`{c}`") for c in docs.columns if c not in added]
    return cut.select(*kept, *added)
