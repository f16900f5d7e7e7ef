"""Long word runs that occur twice or more, by recompression.

Every text is compressed in rounds.  A round first names runs of one symbol, then pairs
of neighbours of which the first is on the left side and the second on the right; a bit of its
name puts a symbol on a side.  A name is a hash of the names it stands for, so all tasks give the same
name to the same words, and no table of names has to be sent around.  With each symbol goes
its context, the range of words that settled how it was made: wherever these words
stand, the same symbol stands in them.

Every window of ``window`` words picks an anchor from its words alone: of the symbols of
the highest level whose contexts lie in it, the one with the smallest hash.  (Words are symbols of level 0 and their own contexts, so
there always is one.)  Equal windows pick equal anchors, so only windows whose anchors are shared can be repeats.

1. Neighbouring windows with one anchor are one row: the anchor's key and a hash of all words of these windows.
2. Keys are counted over all texts.  Rows of a key that occurs once are done.  If all rows of a key have the
   same words, all their windows are repeats.
3. Else the rows are grouped by their words.  Groups of two rows or more are repeats as a whole, and one row of
   every group goes on: its windows are hashed one by one and counted under their key.

Equal texts are one text with a number of copies from the beginning; if there are two copies or more every
window of them is a repeat.  Two 64-bit hashes, the key and another of all words, have to be equal for a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .counted import join_counted
from .packed import column
from .scratch import Scratch

WINDOW = 35
ROUNDS = 3
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_INVERSES = tuple(pow(b, -1, 2**64) for b in _BASES)
_RUN, _PAIR, _SIDE, _PICK, _AT = (np.uint64(x) for x in (0x9E6C63D0876A9A35, 0xC2B2AE3D27D4EB4F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


class Sums:
    """Hashes of any range of words, off prefix sums."""

    def __init__(self, h: np.ndarray, which: int) -> None:
        n = len(h)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(h * W._power(_BASES[which], n), out=self.total[1:])
        self.inverse = W._power(_INVERSES[which], n + 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return W.mix((self.total[b] - self.total[a]) * self.inverse[a] + (b - a).astype(np.uint64))


def levels(h: np.ndarray, first: np.ndarray, rounds: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols of every level, from the words on: names, starts, and starts and ends of contexts.

    ``h`` are the words of several texts, ``first`` where each begins.  A symbol that an end of
    its text settled has a context beyond that end, which no window holds.
    """
    n = len(h)
    names, s, e = h, np.arange(n), np.arange(1, n + 1)
    cs, ce, begin = s, e, np.zeros(n + 1, bool)
    begin[first] = True  # the place after the last symbol counts as a beginning
    out = [(names, s, cs, ce)]
    for r in range(rounds):
        # runs: the symbols before and after a run show that it ends there
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | begin[1:-1]
        i = np.flatnonzero(new)
        end = np.append(i[1:], len(names))
        k = end - i
        name = np.where(k > 1, W.mix(names[i] * _RUN + k.astype(np.uint64)), names[i])
        at_begin, at_end = begin[i], begin[end]
        cs = np.where(at_begin, s[i] - 1, cs[i - 1])
        ce = np.where(at_end, e[end - 1] + 1, ce[np.minimum(end, len(names) - 1)])
        s, e, begin = s[i], e[end - 1], np.append(at_begin, True)
        # pairs: a symbol stays alone because of its neighbour on the one side where it might have found another
        left = (W.mix(name + np.uint64(int(_SIDE) * (r + 1) % 2**64)) & np.uint64(1)).astype(bool)
        m = len(name)
        pair = np.zeros(m, bool)
        pair[:-1] = left[:-1] & ~left[1:] & ~begin[1:m]
        second = np.zeros(m, bool)
        second[1:] = pair[:-1]
        i = np.flatnonzero(~second)
        nxt, paired, lone_left = np.minimum(i + 1, m - 1), pair[i], left[i]
        names = np.where(paired, W.mix(name[i] * _PAIR + name[nxt]), name[i])
        after = np.where(begin[i + 1], e[i] + 1, ce[nxt])
        before = np.where(begin[i], s[i] - 1, cs[i - 1])
        cs = np.where(paired | lone_left, cs[i], before)
        ce = np.where(paired | lone_left, after, ce[i])
        s, e, begin = s[i], np.where(paired, e[nxt], e[i]), np.append(begin[i], True)
        out.append((names, s, cs, ce))
    return out


def _smallest(value: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Index of the first smallest value in each range [p, q)."""
    table = [np.arange(len(value))]
    size = q - p
    while 2 << (len(table) - 1) <= int(size.max()):
        step, low = 1 << (len(table) - 1), table[-1]
        a, b = low[:-step], low[step:]
        table.append(np.where(value[a] <= value[b], a, b))
    out = np.empty(len(p), np.int64)
    height = np.frexp(size.astype(np.float64))[1] - 1
    for k, low in enumerate(table):
        of = np.flatnonzero(height == k)
        a, b = low[p[of]], low[q[of] - (1 << k)]
        out[of] = np.where(value[a] <= value[b], a, b)
    return out


def anchors(h: np.ndarray, first: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (key, words, lo, hi): windows lo to hi, which have one anchor, by the place of their first words."""
    count = np.maximum(np.diff(first) - window + 1, 0)
    wins = np.arange(count.sum()) + np.repeat(first[:-1] - np.cumsum(count) + count, count)
    if not len(wins):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z
    level = np.full(len(wins), -1)
    name, at, c_at, c_end = np.zeros(len(wins), np.uint64), np.zeros_like(wins), np.zeros_like(wins), np.zeros_like(wins)
    left = np.arange(len(wins))
    for k, (names, s, cs, ce) in reversed(list(enumerate(levels(h, first, rounds)))):
        p, q = np.searchsorted(cs, wins[left]), np.searchsorted(ce, wins[left] + window, side="right")
        fit = q > p
        i, left = left[fit], left[~fit]
        if len(i):
            j = _smallest(W.mix(names ^ _PICK), p[fit], q[fit])
            level[i], name[i], at[i], c_at[i], c_end[i] = k, names[j], s[j], cs[j], ce[j]
        if not len(left):
            break
    new = np.ones(len(wins), bool)
    new[1:] = (level[1:] != level[:-1]) | (at[1:] != at[:-1]) | (wins[1:] != wins[:-1] + 1)
    i = np.flatnonzero(new)
    lo, hi = wins[i], wins[np.append(i[1:], len(wins)) - 1]
    key = Sums(h, 0).of(c_at[i], c_end[i])
    key = W.mix(key ^ W.mix(name[i] + level[i].astype(np.uint64)) + _AT * (at[i] - c_at[i]).astype(np.uint64))
    words = W.mix(Sums(h, 1).of(lo, hi + window) + _AT * (at[i] - lo).astype(np.uint64))
    return key, words, lo, hi


def _packed(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (lo << 32) | (hi - lo)


def _sliced(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of texts: rows i to j, bytes, where words of each text begin, word hashes, and byte ranges."""
    data, at = W.utf8(batch.column("text"))
    for i, j in W.slices(at):
        part = data[at[i] : at[j]]
        h, first, s, e = W.words(part, at[i : j + 1] - at[i], lower=False)
        yield i, j, part, first, h, s, e


def _anchored(window: int, rounds: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, copies = batch.column("rid").to_numpy(), batch.column("copies").to_numpy()
            for i, j, _, first, h, _, _ in _sliced(batch):
                key, words, lo, hi = anchors(h, first, window, rounds)
                if len(key):
                    t = np.searchsorted(first, lo, side="right") - 1
                    columns = [key.view(np.int64), words.view(np.int64), rid[i:j][t], _packed(lo - first[t], hi - first[t]), copies[i:j][t]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "words", "rid", "at", "copies"])

    return run


def _windows(window: int):
    """Single windows of the ranges in ``picked`` (key, at, n): rows (key, words, rid, at, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, picked = batch.column("rid").to_numpy(), batch.column("picked")
            lists, of = picked.flatten(), picked.offsets.to_numpy()
            key, at, n = (lists.field(f).to_numpy() for f in ("key", "at", "n"))
            for i, j, _, first, h, _, _ in _sliced(batch):
                a, b = of[i] - of[0], of[j] - of[0]
                t = np.repeat(np.arange(j - i), np.diff(of[i : j + 1]))
                size = (at[a:b] & 0xFFFFFFFF) + 1
                row = np.repeat(np.arange(b - a), size)
                place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[a:b] >> 32, size)
                start = first[t[row]] + place
                words = Sums(h, 1).of(start, start + window)
                columns = [key[a:b][row], words.view(np.int64), rid[i:j][t[row]], _packed(place, place), n[a:b][row]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "words", "rid", "at", "n"])

    return run


def _kept(window: int):
    """Words, removed words, the kept text and the removed ranges of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies, found = batch.column("copies").to_numpy(), batch.column("found")
            for i, j, data, first, h, s, e in _sliced(batch):
                gone, text, spans = [], [], []
                for d in range(i, j):
                    a, b = first[d - i], first[d - i + 1]
                    step = np.zeros(b - a + 1, np.int64)
                    if copies[d] > 1 and b - a >= window:
                        step[0] += 1
                    elif found[d].is_valid:
                        at = np.array(found[d].values)
                        np.add.at(step, at >> 32, 1)
                        np.add.at(step, (at >> 32) + (at & 0xFFFFFFFF) + window, -1)
                    cover = np.cumsum(step[:-1]) > 0
                    gone.append(int(cover.sum()))
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8))).reshape(-1, 2)
                    spans.append([{"first": int(x), "after": int(y)} for x, y in edge])
                    left = np.flatnonzero(~cover) + a
                    size = e[left] - s[left] + 1
                    take = np.arange(size.sum()) + np.repeat(s[left] - np.cumsum(size) + size, size)
                    raw = data[np.minimum(take, len(data) - 1)]
                    raw[np.cumsum(size) - 1] = 32
                    text.append(raw[:-1].tobytes())
                columns = [
                    *(batch.column(c).slice(i, j - i) for c in ("t1", "t2", "copies")),
                    pa.array(np.diff(first)), pa.array(gone, pa.int64()), pa.array(text, pa.binary()).cast(pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["t1", "t2", "copies", "n_words", "n_removed", "kept", "spans"])

    return run


def _texts(docs: DataFrame, store: Scratch, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct texts (rid, t1, t2, copies, text), bucketed by rid, and the rows of docs as (row, t1, t2).

    The first row of each text is found by its two hashes, so no copy is joined with another one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashes = [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("other"), text).alias("t2")]
    others = F.struct(F.lit(0).alias("_"), *[column(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col])
    rows = store.keep(docs.select(others.alias("row"), F.col(id_col).alias("id"), *hashes), "rows")
    classes = rows.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.min("id").alias("id"))
    rid = F.xxhash64("id", "t1", "t2").alias("rid")
    own = docs.select(F.col(id_col).alias("id"), *hashes, text.alias("text")).select(rid, "t1", "t2", "text")
    texts = own.join(classes.select(rid, "copies").hint("shuffle_hash"), "rid")
    # rows with one id and one text are one key here, and lie in one partition already
    return store.keep_by(texts.select("rid", "t1", "t2", "copies", "text").distinct(), "rid", "texts"), rows


def _repeats(texts: DataFrame, store: Scratch, window: int, rounds: int) -> DataFrame:
    """Rows (rid, found): the ranges of windows of each text without copies that are repeats."""
    occ = store.keep(texts.mapInArrow(_anchored(window, rounds), "key long, words long, rid long, at long, copies long"), "anchors")
    keys = occ.groupBy("key").agg(F.sum("copies").alias("of"), F.count("*").alias("n"), (F.min("words") != F.max("words")).alias("mixed"))
    keys = store.keep(keys.where("`of` > 1").drop("of"), "keys")
    shared = store.keep(join_counted(occ, keys, ["key"], "n"), "shared")
    store.drop(occ, keys)
    single = F.col("copies") == 1
    whole = shared.where(single & ~F.col("mixed")).select("rid", "at")

    mixed = shared.where("mixed")
    alike = mixed.groupBy("key", "words").agg(F.sum("copies").alias("of"), F.count("*").alias("n"), F.min(F.struct("rid", "at")).alias("one"))
    alike = store.keep(alike, "alike")
    grouped = join_counted(mixed.where(single).select("key", "words", "rid", "at"), alike.where("`of` > 1").select("key", "words", "n"), ["key", "words"], "n")

    picked = alike.select("key", "one.rid", "one.at", F.col("of").alias("n")).groupBy("rid").agg(F.collect_list(F.struct("key", "at", "n")).alias("picked"))
    lines = texts.select("rid", "text").join(picked.hint("shuffle_hash"), "rid")
    each = store.keep(lines.mapInArrow(_windows(window), "key long, words long, rid long, at long, n long"), "windows")
    often = store.keep(each.groupBy("key", "words").agg(F.count("*").alias("c")).where("c > 1"), "often")
    # windows of groups of two or more are known; they only show that others are repeats
    alone = join_counted(each.where("n = 1").select("key", "words", "rid", "at"), often, ["key", "words"], "c")
    return whole.unionByName(grouped.select("rid", "at")).unionByName(alone.select("rid", "at")).groupBy("rid").agg(F.collect_list("at").alias("found"))


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rounds: int = ROUNDS, digest: bool = False
) -> DataFrame:
    """The documents without repeated passages, with n_words, n_removed and spans.

    A word is removed if a window of ``window`` words that covers it begins anywhere else too, in the same
    document or another one.  The text becomes the words that stay, joined by one space (``digest``: its SHA-256, which saves moving the
    texts); spans are the removed ranges of words, first to before after.  What repeats is judged on the input.

    Defined cases: a null or empty text has no words and comes out empty; of rows with equal texts of ``window`` words or
    more nothing stays; shorter texts stay whole; null and repeated ids are rows like others; no rows give no rows; all other columns
    pass through, but columns named n_words, n_removed and spans are replaced.
    """
    store = Scratch(docs.sparkSession, "substrings")
    texts, rows = _texts(docs, store, id_col, text_col)
    found = _repeats(texts, store, window, rounds)
    both = texts.join(found.hint("shuffle_hash"), "rid", "left").select("t1", "t2", "copies", "text", "found")
    done = both.mapInArrow(
        _kept(window), "t1 long, t2 long, copies long, n_words long, n_removed long, kept string, spans array<struct<first: long, after: long>>"
    )
    if digest:
        done = done.withColumn("kept", F.sha2("kept", 256))
    done = store.keep(done, "kept")
    store.drop(texts)
    made = ("n_words", "n_removed", "spans")
    others = [(i, c) for i, c in enumerate(docs.columns) if c != text_col and c not in made]
    out = join_counted(rows, done, ["t1", "t2"], "copies")
    names: dict[str, Column] = {c: F.col(f"row.c{i}") for i, c in others} | {text_col: F.col("kept")}
    return out.select(*[names[c].alias(c) for c in docs.columns if c in names], *made)


#: DuckDB SQL of the digest query.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
o AS (SELECT *, list(word) OVER x AS l FROM p WINDOW x AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
h AS (SELECT doc_id, i, word, CASE WHEN len(l) = 35 THEN md5(array_to_string(l, ' ')) END AS win FROM o),
r AS (SELECT win FROM h WHERE win IS NOT NULL GROUP BY win HAVING count(*) > 1),
m AS (SELECT h.doc_id, h.i, h.word, r.win IS NOT NULL AS hit FROM h LEFT JOIN r ON h.win = r.win),
c AS (SELECT *, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM m),
k AS (SELECT doc_id, count(*) AS n, sum(gone)::BIGINT AS g, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(k.n, 0)::BIGINT AS n_words, coalesce(k.g, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
