"""Substring dedup, importance resampling and spelling variants against brute force, and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from winnowry.llm import counted, recompression, resampling, variants
from winnowry.llm.scratch import Scratch


# ---- substrings ----
def brute_kept(texts, window):
    cut = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in cut for i in range(len(w) - window + 1))
    out = []
    for w in cut:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        spans = [i for i in sorted(gone) if i - 1 not in gone], [i + 1 for i in sorted(gone) if i + 1 not in gone]
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone), list(zip(*spans, strict=True))))
    return out


def passages(r, n, letters):
    """Texts of few different words with shared passages, periodic runs, near and exact copies."""
    shared = [[r.choice(letters) for _ in range(r.randint(3, 60))] for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 6)):
            kind = r.random()
            if kind < 0.4:
                parts += r.choice(shared)
            elif kind < 0.6:
                parts += [r.choice(letters) for _ in range(r.randint(1, 3))] * r.randint(1, 30)
            else:
                parts += [r.choice(letters) for _ in range(r.randint(1, 40))]
        texts.append(r.choice([" ", "\n", " \t"]).join(parts))
    return texts + texts[:3] + [t + " end" for t in texts[3:6]] + [" ".join(t.split()) for t in texts[6:9]]


@pytest.mark.parametrize("window,rounds,letters", [(35, 3, ["ab", "Ab", "é", "x"]), (6, 3, list("abc")), (5, 0, list("abcd")), (12, 5, list("ab")), (1, 2, [str(i) for i in range(500)])])
def test_substrings_equal_brute_force(spark, window, rounds, letters):
    texts = passages(random.Random(window), 40, letters)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = recompression.dedup_substrings(df, window=window, rounds=rounds).orderBy("doc_id").collect()
    got = [(x["n_words"], x["n_removed"], x["text"], [tuple(s) for s in x["spans"]]) for x in rows]
    assert got == brute_kept(texts, window)
    assert sum(x[1] > 0 for x in got) > 8


def test_substrings_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [
        (1, None, 1, "a"), (2, "", 2, "b"), (2, "", 2, "b"), (None, long, 3, None), (None, long, 3, None), (3, f"{long} tail", 4, "c"),
        (4, "a b c", 5, "d"), (5, "a b c", 6, "e"), (6, "\n \t", 7, "f"), (7, "x " * 30_000, 8, "g"), (8, " ".join(f"v{i}" for i in range(30_000)), 9, "h"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid long, `a.b` string").selectExpr("*", "rid AS key", "rid AS spans")
    out = recompression.dedup_substrings(df)
    assert out.columns == ["doc_id", "text", "rid", "a.b", "key", "n_words", "n_removed", "spans"]
    got = Counter((x["doc_id"], x["text"], x["n_words"], x["n_removed"], x["rid"]) for x in out.collect())
    assert got == Counter([
        (1, "", 0, 0, 1), (2, "", 0, 0, 2), (2, "", 0, 0, 2), (None, "", 50, 50, 3), (None, "", 50, 50, 3), (3, "tail", 51, 50, 4),
        (4, "a b c", 3, 0, 5), (5, "a b c", 3, 0, 6), (6, "", 0, 0, 7), (7, "", 30_000, 30_000, 8), (8, rows[-1][1], 30_000, 0, 9),
    ])
    assert recompression.dedup_substrings(df.where("false")).count() == 0
    plain = recompression.dedup_substrings(df.select("doc_id", "text"), digest=True).where("doc_id = 3").first()
    assert plain["text"] == hashlib.sha256(b"tail").hexdigest()


def test_symbols_of_a_run_do_not_depend_on_what_surrounds_it():
    """A symbol whose context lies in a common run of words stands in every text with this run."""
    r = np.random.default_rng(4)
    run = r.integers(0, 9, 60).astype(np.uint64)
    around = [np.concatenate([r.integers(0, 9, 40).astype(np.uint64), run, r.integers(0, 9, 40).astype(np.uint64)]) for _ in range(20)]
    h, first = np.concatenate(around), np.arange(0, 2801, 140)
    h = recompression.W.mix(h + np.uint64(77))
    for names, s, cs, ce in recompression.levels(h, first, 4):
        inside = []
        for d in range(20):
            a = d * 140 + 40
            at = (cs >= a) & (ce <= a + 60)
            inside.append(list(zip(names[at].tolist(), (s[at] - a).tolist(), strict=True)))
        assert inside[0] and all(x == inside[0] for x in inside)


def test_frequent_keys_join_without_loss(spark):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 100, i) for i in range(20_000)] + [(None, -1)], "k long, v long")
    table = rows.groupBy("k").count().where("k IS NOT NULL AND k <> 5")
    got = counted.join_counted(rows, table, ["k"], "count")
    assert got.count() == rows.where("k <> 5").count() == got.select("v").distinct().count()


# ---- resampling ----
def brute_resample(docs, target, longest, buckets, least):
    table = {c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(table.get(c, c) for c in t or ""))

    def feats(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(feats(text))
    for text in target:
        t.update(feats(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for doc, text in docs:
        f = feats(text)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least])
    may = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0]))
    drawn = len(may) * 30 // 100
    ranks = {id(x): i for i, x in enumerate(may[:drawn], 1)}
    return [(*x[:4], ranks.get(id(x))) for x in out]


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (2, 97), (3, 1000)])
def test_resampling_equals_brute_force(spark, longest, buckets):
    r = random.Random(longest)
    vocab = ["The", "éa", "b2", "ÄÖ", "CAR", "x-y", "中文", "end."]
    docs = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 2, 5, 30])))) for i in range(60)]
    docs += [(100, None), (101, "\x7f -- "), (None, "the " * 9), (102, docs[5][1]), (103, docs[5][1]), (103, docs[5][1]), (104, "car " * 20_000)]
    target = ["the car", "CAR car b2", None, ""]
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, weight long")
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    out = resampling.importance_resample(df, goal, longest=longest, buckets=buckets, percent=30, least_words=3)
    assert out.columns == ["doc_id", "text", "n_features", "weight", "score", "rank"]
    got = out.select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert Counter(map(tuple, got)) == Counter(brute_resample(docs, target, longest, buckets, 3))
    assert resampling.importance_resample(df.where("false"), goal).count() == 0
    bare = resampling.importance_resample(df, goal.where("false"), longest=longest, buckets=50, percent=30, least_words=3)
    got = bare.select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert Counter(map(tuple, got)) == Counter(brute_resample(docs, [], longest, 50, 3))


# ---- variants ----
def brute_variants(docs, least, count, ratio, every):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= count}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, out = {}, {}
    for w in n:
        by = sorted((-n[u], u) for u in n if near(w, u))
        good = by and -by[0][0] >= ratio * n[w]
        form[w] = by[0][1] if good else None
        out[w] = (w, form[w], n[w], len(by), -by[0][0] if good else None)

    def root(w):
        return w if form[w] is None else root(form[w])

    return Counter((*x, root(x[0])) for x in out.values())


def test_variants_equal_brute_force(spark):
    r = random.Random(8)
    bases = ["".join(r.choice("abcéÿ÷") for _ in range(r.randint(2, 9))) for _ in range(30)] + ["a" * k for k in range(3, 9)] + ["abcabc", "acbabc", "bcabca"]
    docs = []
    for i in range(300):
        words = []
        for _ in range(r.choice([0, 5, 40])):
            w = bases[min(int(r.expovariate(0.15)), len(bases) - 1)]
            while r.random() < 0.3 and len(w) > 1:
                p = r.randrange(len(w))
                w = r.choice([w[:p] + w[p + 1 :], w[:p] + r.choice("abz") + w[p:], w[:p] + r.choice("abz") + w[p + 1 :]])
            words.append(r.choice([w, w.upper() if w.isascii() else w]))
        docs.append((i, r.choice([" ", "1", "-", "\n"]).join(words)))
    docs += [(None, "aaaa aaab"), (5, None), (6, ""), (1007, "日本"), (1007, "aaaa"), (1007, "aaaa"), (8, "abc" * 5000), (9, "abc" * 5000)]
    df = spark.createDataFrame([(*x, "n", "k") for x in docs], "doc_id long, text string, word string, key string")
    cols = ["word", "form", "n", "n_near", "form_n", "root"]
    for least, count, ratio, every in ((3, 2, 5, 19), (4, 1, 2, 7)):
        out = variants.spelling_variants(df, least_letters=least, least_count=count, ratio=ratio, typo_every=every).select(cols)
        want = brute_variants(docs, least, count, ratio, every)
        assert Counter(map(tuple, out.collect())) == want and sum(x[1] is not None for x in want) > 20
    assert variants.spelling_variants(df.where("false")).count() == 0
    plain = variants.word_counts(df.where("doc_id = 1007"), least_letters=2)
    assert [tuple(x) for x in plain.collect()] == [("aaaa", 2)]


def test_anagrams_do_not_meet_in_masses(spark):
    """Words of the same letters share keys; only those with an equal half are compared."""
    r = random.Random(2)
    words = {"".join(r.sample("abcdefghij", 10)) for _ in range(1500)}
    keyed = variants.with_keys(spark.createDataFrame([(w, 9) for w in words], "word string, n long"))
    assert keyed.select("key").distinct().count() == 1 and variants.near_words(keyed).count() == 0


def test_exploded_words_are_not_broadcast(spark):
    """A stored table of words is small, but its rows of a letter each are not; Spark sizes them by the file."""
    words = spark.createDataFrame([("abcdef", 9), ("abcdeg", 50), ("abcde", 60)], "word string, n long")
    near = variants.near_words(Scratch(spark, "t").keep(variants.with_keys(words)))
    whole = variants.group_variants(words, Scratch(spark, "t"))
    assert near.count() == 6 and whole.where("root = 'abcde'").count() == 2
    for out in (near, whole):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(21)] + [("a", "b")], "word string, form string")
    got = dict(map(tuple, variants.roots(forms, Scratch(spark, "t")).collect()))
    assert got == {f"w{i}": "w21" for i in range(21)} | {"a": "b"}
