"""The operators against brute force, exact round trips, and odd rows."""

import hashlib
import random
import re
import subprocess
import sys

import duckdb
import numpy as np
from pyspark.sql import functions as F

from winnowry.llm import bpe, chat, fingerprint, html_crf, jpeg, line_dedup, linking, media, mixing, near_dedup, quality, toxicity
from winnowry.llm.queries import vocabulary
from winnowry.llm.scratch import Scratch

DATA = "/root/testdata/sf0.001"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- page text ----
def test_page_text_of_layouts():
    chain = html_crf.default_chain()
    page = """<html><head><title>x</title></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-banner">We use cookies.</div><article><h1>Fish &amp; chips</h1><script>var a="</p>";</script><p>First   line
goes here, with <b>bold</b> text.<p>Second one &#x41; too.</article><section id="comments"><h3>Comments</h3><p>nice</p></section>
<aside><p>Related</p><ul><li><a href=/c>C</a></ul></aside><footer>&copy; me</footer>"""
    assert html_crf.main_text(page, chain) == "Fish & chips\n\nFirst line goes here, with bold text.\n\nSecond one A too."
    assert html_crf.main_text(None, chain) == html_crf.main_text("", chain) == html_crf.main_text("<p", chain) == ""


def test_chain_labels_new_pages():
    chain = html_crf.default_chain()
    pages = html_crf.labelled_pages(100, seed=77)
    assert sum(chain.viterbi(chain.scores(html_crf.leaf_blocks(p))) == y for p, y in pages) >= 0.97 * len(pages)


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(0)
    chain = html_crf.Chain({}, np.zeros((0, 2)), r.normal(size=(2, 2)))
    s = [tuple(x) for x in r.normal(size=(8, 2)).tolist()]
    value = lambda p: sum(s[i][v] for i, v in enumerate(p)) + sum(chain.move[a][b] for a, b in zip(p, p[1:], strict=False))
    best = max(([int(c) for c in f"{k:08b}"] for k in range(256)), key=value)
    assert chain.viterbi(s) == best


# ---- links ----
def brute_components(n, edges):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(30)] + [(r.randrange(40, 90), r.randrange(40, 90)) for _ in range(40)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {x["id"]: x["comp"] for x in linking.connected_components(df, Scratch(spark, "t")).collect()}
    want = brute_components(90, edges)
    assert all(got.get(i, i) == want[i] for i in range(90))


def test_link_compares_all_members_of_a_bucket(spark):
    """Members linked only along a path: every neighbour must be found though pivots come by salt."""
    members = spark.createDataFrame([(1, i) for i in range(40)], "key long, id long")
    store = Scratch(spark, "t")
    labels, links = linking.link(linking.shared_members(members, store), lambda p: p.where("b - a = 1"), store, fan=2)
    assert links.select("a", "b").distinct().count() == 39 and {x["comp"] for x in labels.collect()} == {0}


# ---- lines ----
def test_line_dedup_cases(spark):
    long = "the quick brown fox jumps over the lazy dog and runs away from all the other animals of the forest"
    docs = [
        (1, long + "\nonly here", "x"), (2, "intro\n" + long.replace("lazy", "lazi"), "y"), (3, long, None), (4, None, "z"), (5, "", ""),
        (None, "only here\nnobody else has this line", "n"), (6, "a\n\na\nb", "t"), (6, "a\n\na\nb", "t"), (7, "中" * 50 + "\n" + "x" * 5000, "t"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, _row string")
    out = line_dedup.dedup_lines(df)
    got = sorted((r["doc_id"] or 99, r["text"], r["n_lines"], r["n_kept"]) for r in out.collect() if r["text"] is not None)
    assert got == sorted([
        (1, long + "\nonly here", 2, 2), (2, "intro", 2, 1), (3, "", 1, 0), (5, "", 0, 0), (99, "nobody else has this line", 2, 1),
        (6, "a\n\nb", 3, 2), (6, "a\n\nb", 3, 2), (7, "中" * 50 + "\n" + "x" * 5000, 2, 2),
    ])
    assert out.columns == ["doc_id", "text", "_row", "n_lines", "n_kept"]
    assert line_dedup.dedup_lines(df.where("false")).count() == 0


def test_line_components_recall(spark):
    r = random.Random(5)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(400)]
    lines = [" ".join(r.choice(words) for _ in range(r.randint(4, 60))) for _ in range(120)]
    for i in range(100):
        w = lines[i].split()
        w[r.randrange(len(w))] = "edited"
        lines.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    comps, _ = line_dedup.line_components(df, Scratch(spark, "t"))
    ids = {x["id"]: x["i"] for x in df.select("doc_id", F.xxhash64("text").alias("id")).withColumnRenamed("doc_id", "i").collect()}
    got = {ids[x["id"]]: x["comp"] for x in comps.collect()}
    sets = [{t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in lines]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = sum(a in got and got[a] == got.get(b) for a, b in pairs)
    assert found >= 0.97 * len(pairs) > 50
    wrong = brute_components(len(lines), pairs)
    assert all(wrong[a] == wrong[b] for a in got for b in got if got[a] == got[b])


def test_lines_of_any_length_meet(spark):
    """A repeated text has few distinct slices however long the line is."""
    once = "the committee will meet again on Thursday afternoon to settle the budget of the new library"
    lines = [once, f"{once} {once}", "-" * 60, "-" * 200, "=-" * 500, "=-" * 20]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    comps, known = line_dedup.line_components(df, Scratch(spark, "t"))
    got = {x["first_doc"]: x["comp"] for x in comps.join(known, "id").collect()}
    assert len(got) == 6 and got[0] == got[1] and got[2] == got[3] and got[4] == got[5] and len(set(got.values())) == 3


def test_lines_find_what_brute_force_finds(spark):
    """Separators, other scripts, repeated characters and plain lines; in all, every link that brute force finds."""
    r = random.Random(21)
    han = [chr(c) for c in range(0x4E00, 0x4F00)]
    lines = ["-" * n for n in (7, 8, 60, 130, 140, 900)] + ["=" * 60, "=" * 61, "* " * 30, "* " * 200, "\u3000".join("中文") * 30]
    for alphabet, n in ((han, 60), ("abcdefghij ", 40), ("ab", 25), ("é😀xyz ", 25)):
        for _ in range(n):
            line = "x" + "".join(r.choice(alphabet) for _ in range(r.choice((5, 9, 40, 200, 700)))) + "x"
            w = list(line)
            w[r.randrange(len(w))] = "§"
            lines += [line, "".join(w), line + "!"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    comps, known = line_dedup.line_components(df, Scratch(spark, "t"))
    got = {x["first_doc"]: x["comp"] for x in comps.join(known, "id").collect()}
    sets = [{t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in lines]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if lines[a] != lines[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(pairs) > 200 and all(a in got and got[a] == got.get(b) for a, b in pairs)
    want = brute_components(len(lines), pairs)
    assert all(want[a] == want[b] for a in got for b in got if got[a] == got[b])


def test_signatures_do_not_depend_on_the_order_of_work(spark, monkeypatch):
    """Skipping large hashes leaves the values of every line as they are."""
    r = random.Random(3)
    lines = ["".join(r.choice("abcdef ") for _ in range(n)) for n in (100, 300, 900, 5000) for _ in range(6)] + ["ab" * 400, "q" * 3000]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")

    def keys():
        store = Scratch(spark, "t")
        lines = line_dedup.distinct_lines(df, store, "doc_id", "text")
        return {x["id"]: (x["keys"], x["q0"], x["q1"]) for x in line_dedup.signatures(lines, store, 8).collect()}

    some = keys()
    monkeypatch.setattr(line_dedup, "_ENOUGH", 10**6)
    assert keys() == some and len(some) == len(lines)


def test_signatures_are_stored_as_they_are_read(spark):
    """Keys are made once: the stored tables hold them in place of the sixteen values, which no later step reads."""
    df = spark.createDataFrame([(1, "a line that two documents hold, more or less\n" + "xy" * 200)], "doc_id long, text string")
    store = Scratch(spark, "t")
    signed = line_dedup.signatures(line_dedup.distinct_lines(df, store, "doc_id", "text"), store, 8)
    some, rest = signed._scratch_parts
    assert some.columns == ["id", "bare", "keys", "q0", "q1"] and rest.columns == signed.columns == ["id", "keys", "q0", "q1"]
    assert [len(x["keys"]) for x in signed.collect()] == [len(line_dedup.BANDS)] * 2 and some.where("bare").count() == 1


def test_line_recall_at_the_threshold(spark):
    """Isolated pairs whose similarity is 0.80 to 0.82: nothing else leads to them."""
    r = random.Random(8)
    sets = lambda t: {t[i : i + 8] for i in range(len(t) - 7)}
    pairs = []
    while len(pairs) < 2000:
        a = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(r.randint(60, 300)))
        w = list(a)
        for i in r.sample(range(len(w)), r.randint(1, 4)):
            w[i] = "#"
        x, y = sets(a), sets(b := "".join(w))
        if 0.8 <= len(x & y) / len(x | y) < 0.82 and a.strip() and b.strip():
            pairs.append(f"{a}\n{b}")
    df = spark.createDataFrame(list(enumerate(pairs)), "doc_id long, text string")
    comps, known = line_dedup.line_components(df, Scratch(spark, "t"))
    assert comps.join(known, "id").select("first_doc").distinct().count() >= 0.99 * len(pairs)


def test_wide_buckets_are_dealt_and_compared_whole(spark, monkeypatch):
    """Every pivot meets every member of its bucket in another component, also over slices, in as many tasks as asked for."""
    monkeypatch.setattr(linking, "SLICE", 5)
    r = random.Random(3)
    buckets = [[(key, 100 * key + i, r.randrange(4), i % 3, size, r.randrange(6) if i % 3 else None) for i in range(size)] for key, size in enumerate((1, 5, 6, 40))]
    rows = [x for b in buckets for x in b]
    df = spark.createDataFrame(rows, "key long, id long, score long, comp long, of long, pick long")
    pivots = {}
    for x in sorted(x for x in rows if x[5] is not None):
        best = pivots.get((x[0], x[5]))
        pivots[x[0], x[5]] = x if best is None or (x[2], -x[1]) > (best[2], -best[1]) else best
    want = {(min(x[1], p[1]), max(x[1], p[1])) for (key, _), p in pivots.items() for x in buckets[key] if x[3] != p[3]}
    out = linking._met_wide(df, [], F.lit(True), 7)
    assert {tuple(x) for x in out.collect()} == want and len(want) > 50
    assert out.rdd.getNumPartitions() == 7


def test_condition_of_wide_buckets_is_small_code(spark):
    """Methods of more than 8,000 bytes are not compiled by the JVM; packed words give the same answers."""
    r = random.Random(4)
    n, names = 32, [f"w{i}" for i in range(32)]
    rows = []
    for i in range(60):
        w = [r.getrandbits(63) for _ in range(n)] if not i % 6 else [x ^ (r.getrandbits(6) if r.random() < 0.1 * (i % 6) else 0) for x in rows[-1][-n:]]
        rows.append((i % 3, i, r.randrange(900, 1000), sum(bin(x).count("1") for x in w), r.getrandbits(60), r.getrandbits(60), [i, i % 7], *w))
    df = spark.createDataFrame(rows, "key long, id long, n long, ones long, q0 long, q1 long, keys array<long>, " + ", ".join(f"{x} long" for x in names))
    of = lambda c: c(F.col, lambda x: F.col(f"p.{x}"))
    same = F.array_min(F.array_intersect("keys", "p.keys")) == F.col("key")

    def met(packed, *more):
        t = df.withColumn("words", F.array(*names)).drop(*names) if packed else df
        t = Scratch(spark, "t").keep(t)
        pivots = t.select("key", F.struct(*[c for c in t.columns if c != "key"]).alias("p"))
        holding = of(linking.few_bits_apart(n, 80, 4, packed=True) if packed else linking.few_bits_apart(n, 80, 4))
        for c in more:
            holding = c & holding
        return t.join(pivots.hint("merge"), "key").where(holding).select("id", "p.id")

    got = sorted(map(tuple, met(True).collect()))
    assert got == sorted(map(tuple, met(False).collect())) and 60 < len(got) < 1200
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = met(True, of(line_dedup._likely(80)), same)._jdf.queryExecution().executedPlan()
        wide = met(False, of(line_dedup._likely(80)), same)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    code = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    longest = lambda p: max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code.codegenString(p))), default=0)
    assert longest(plan) < 8000 < longest(wide)


# ---- documents ----
def brute_near(texts, k, percent):
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    edges = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return [len(s) for s in sets], brute_components(len(sets), edges)


def test_near_groups_against_brute_force(spark):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghijé") for _ in range(r.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in [*range(12), *[r.randint(20, 400) for _ in range(40)]]]
    for i in range(12, 52):
        for edits in (1, 2, 4):
            w = texts[i].split()
            for _ in range(edits):
                w[r.randrange(len(w))] = r.choice(words)
            texts.append(" ".join(w))
    texts += [None, "", "  \t\n", "One two", "one TWO", "ÉCOLE à é", "école à é", "x " * 30_000, "x " * 29_000, texts[20]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x["doc"]: (x["n"], x["component"]) for x in near_dedup.near_groups(df, Scratch(spark, "t"), k=3, percent=85).collect()}
    size, comp = brute_near(texts, 3, 85)
    assert [got[i][0] for i in range(len(texts))] == size
    assert [got[i][1] for i in range(len(texts))] == comp


def test_near_dedup_keeps_one_and_all_columns(spark):
    t = "a b c d e f g h i j k l m n o p"
    df = spark.createDataFrame([(2, t, 1), (1, t, 2), (3, None, 3), (4, "", 4), (None, t, 5), (5, "q r s t u", 6)], "doc_id long, text string, check int")
    out = near_dedup.near_dedup(df)
    assert out.columns == df.columns and sorted(x["check"] for x in out.collect()) == [2, 3, 4, 6]
    assert near_dedup.near_dedup(df.where("false")).count() == 0


def test_short_near_groups_against_brute_force(spark):
    """At 80 % sets of four and five shingles are linked already."""
    r = random.Random(12)
    texts = []
    for n in [*range(5, 32)] * 3:
        w = [f"w{r.randrange(10**6)}" for _ in range(n)]
        texts += [" ".join(w), " ".join([*w, "more"]), " ".join(["less", "or", *w])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc"]: x["component"] for x in near_dedup.near_groups(df, Scratch(spark, "t")).collect()}
    _, comp = brute_near(texts, 5, 80)
    assert [got[i] for i in range(len(texts))] == comp and len(set(comp)) < len(texts)


def test_short_keys_lose_no_link():
    r = np.random.default_rng(4)
    for percent in (60, 80, 85, 90):
        for _ in range(1500):
            u = r.integers(0, 2**63, 20, dtype=np.uint64)
            i, j, k = r.integers(1, 17), *r.integers(0, 3, 2)
            a, b = np.sort(u[: i + j]), np.sort(np.concatenate([u[:i], u[17 : 17 + k]]))
            if 100 * i >= percent * (i + j + k) and j + k and i + j <= 17:
                assert len(np.intersect1d(near_dedup.short_keys(a, percent), near_dedup.short_keys(b, percent)))
                assert min(len(a), len(b)) >= near_dedup.smallest_linked(percent)


def test_bands_find_pairs_at_the_threshold():
    r = np.random.default_rng(6)
    for percent in (80, 85):
        left, right = [], []
        for _ in range(2000):
            u = r.integers(0, 2**64, 200, dtype=np.uint64)
            half = (200 + 2 * percent) // 2
            left.append(np.sort(u[:half]))
            right.append(np.sort(np.concatenate([u[: 2 * percent], u[half:]])))
        a, b = (near_dedup.band_keys(near_dedup.registers(x)[0], percent) for x in (left, right))
        assert (a == b).any(axis=1).mean() >= 0.999


def test_estimate_loses_no_pair_at_the_threshold(spark):
    """The condition before verification holds for pairs at the threshold, whatever their size."""
    r = np.random.default_rng(16)
    rows = []
    for percent, step in ((80, 20), (85, 1)):
        for n in (25, 60, 120, 300, 900, 5000):
            n = n // step * step
            for _ in range(1500 if n < 1000 else 200):
                common = -(-2 * n * percent // (100 + percent))  # of two sets of n
                u = r.integers(0, 2**64, 2 * n - common, dtype=np.uint64)
                reg = near_dedup.packed(near_dedup.registers([np.sort(u[:n]), np.sort(u[n - common :])])[1]).tolist()
                rows.append((percent, n, n, *reg[0], *reg[1]))
    quads = [f"q{i}" for i in range(16)]
    df = spark.createDataFrame(rows, ["percent", "n", "m", *quads, *[f"r{q}" for q in quads]])
    right = lambda c: F.col("m" if c == "n" else f"r{c}")
    for percent in (80, 85):
        assert df.where(df.percent == percent).where(~near_dedup._likely(percent)(F.col, right)).count() == 0


def test_sketch_estimates_similarity():
    r = np.random.default_rng(2)
    a = np.unique(r.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[: int(len(a) * 0.9)], r.integers(0, 2**63, 300, dtype=np.uint64)]))
    x, y = near_dedup.registers([a, b])[0]
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((x == y).mean() - true) < 0.1 and (x > 0).all()


# ---- tokens ----
def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{DATA}/documents.parquet'").fetchall()]
    texts += [None, "", "   ", "<|endoftext|> a<|startoftext|>b", "ΑΣ Σ 漢字 😀😀 it's we'll don't 4.5 \x1c\x00 é", "z" * 3000, "!" * 90, "ab" * 70]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for r in bpe.encode(df, vocabulary).collect():
        ids = tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == tok.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == sha(" ".join(map(str, ids))) and r["decoded_sha256"] == sha(r["decoded"])


# ---- media ----
def test_media_round_trip():
    r = np.random.default_rng(1)
    odd = np.array([64, 65, 63, 66, 100], np.uint8)
    payloads = [bytes(64), bytes(r.integers(0, 256, 64 * 31, dtype=np.uint8)), bytes(r.choice(odd, 64 * 90, p=[0.9, 0.04, 0.04, 0.01, 0.01])), b"text " * 320]
    files = media.to_media(payloads)
    assert [x[0] for x in media.from_media(files)] == payloads == [media.from_media([f])[0][0] for f in files]


def test_coefficients_follow_from_all_scans():
    """Dropping the refinement scans leaves the coarser coefficients: the scans do accumulate."""
    x = np.arange(-96, 96).reshape(3, 64)
    f = jpeg.parse(jpeg.encode([x], [b"0"])[0])
    coarse = jpeg.decode([f._replace(scans=f.scans[:5], data=f.data[:5])])[0]
    fine = jpeg.decode([f])[0]
    assert np.array_equal(fine[0][0, 0], x[0]) and np.array_equal(coarse[0][0, 0, 1:], (np.sign(x) * (np.abs(x) // 2 * 2))[0, 1:])


def test_inverse_transform_and_upsampling():
    x = np.zeros((6, 64), int)
    x[:4, 0], x[4, 0], x[5, 0] = 80, 40, -16  # flat blocks: sample = 128 + coefficient / 8
    f = jpeg.parse(jpeg.encode([x], [b"0"])[0])
    t = jpeg.rgb(f, jpeg.decode([f])[0])
    assert t.shape == (16, 16, 3) and (t == [135, 138, 147]).all()  # 138 with chroma 133 and 126


def test_media_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "abc"), (3, "abc"), (4, "é" * 40_000)], "doc_id long, text string")
    got = {(r["doc_id"], len(r["payload"])) for r in media.text_media(df).collect()}
    assert got == {(1, 64), (2, 64), (3, 64), (4, 80_000)}
    blobs = spark.createDataFrame([(bytearray(media.to_media([bytes(64)])[0]),), (bytearray(b"no"),), (None,)], "media binary")
    assert sorted((r["height"] or 0, r["width"] or 0) for r in media.tensors(blobs).collect()) == [(0, 0), (0, 0), (16, 16)]


# ---- fingerprints ----
def test_spans_and_extensions():
    a, b = "abcabcabd" * 50, "xxabcabcabd" * 50
    p, q = fingerprint.Prefix(fingerprint.points(a)), fingerprint.Prefix(fingerprint.points(b))
    assert p.span(0, 3) == p.span(3, 6) == q.span(2, 5) != p.span(6, 9)
    assert p.common(0, q, 2) == 9 and p.common(3, p, 0) == 5 and p.common(0, p, 0) == len(a)


def test_fingerprint_rows(spark):
    texts = {9: "first text of all, somewhat longer", 7: None, 5: "short", 3: "first text of all, somewhat longer", 1: "ünïcode 😀 text"}
    df = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(df, parts=3).collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        t, n = texts[i] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert got[i]["edited_sha256"] == sha(edited) and got[i]["n_chars"] == len(t)
        assert got[i]["edited_fingerprint"] == fingerprint.fingerprint(edited) and 0 <= got[i]["near_next"] <= 1
    assert got[9]["fingerprint"] == got[3]["fingerprint"]
    one = fingerprint.fingerprints(df.where("doc_id = 5")).collect()
    assert one[0]["near_next"] == 1.0 and fingerprint.fingerprints(df.where("false")).count() == 0


# ---- classifiers ----
def test_counterfactual_penalty_evens_identity_terms():
    hash_ = lambda s: np.unique(toxicity.word_hashes(s.split()))
    bad = [hash_(f"you muslims are idiot w{i}") for i in range(60)]
    good = [hash_(f"nice weather for christians today w{i}") for i in range(200)]
    y = np.array([1] * 60 + [0] * 200, float)
    weight = lambda m, w: dict(zip(m.keys.tolist(), m.weights.tolist(), strict=True)).get(int(toxicity.word_hashes([w])[0]), 0.0)
    free, tied = toxicity.train([*bad, *good], y, swap=0.0), toxicity.train([*bad, *good], y, swap=5.0)
    gap = lambda m: weight(m, "muslims") - weight(m, "christians")
    assert abs(gap(tied)) < 0.3 * abs(gap(free)) and weight(tied, "idiot") > 1


def test_scores_of_odd_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "😀"), (-3, "😀")], "doc_id long, text string")
    scored = toxicity.score(docs.unionByName(more), toxicity.fit(docs, labels.select("doc_id", "toxic")))
    assert scored.where("score BETWEEN 0 AND 1").count() == docs.count() + 4
    model = quality.fit(docs, labels.select("doc_id", "quality"))
    assert quality.score(more, *model).where("score BETWEEN 0 AND 1").count() == 4
    none = labels.where("false")
    assert {r["score"] for r in quality.score(more, *quality.fit(docs, none.select("doc_id", "quality"))).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score(more, toxicity.fit(docs, none.select("doc_id", "toxic"))).collect()} == {0.5}


# ---- mixing ----
def test_mixing_targets_and_copies(spark):
    r = random.Random(4)
    rows = [(i, "w " * r.randint(0, 30), r.choice(["a", "b", "c", None])) for i in range(500)] + [(900, None, "empty"), (901, "x", "tiny"), (901, "x", "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).select("row.*", "size", "source_size", "target", "copies").collect()
    total = sum(x["size"] for x in got)
    goal = {x["source"]: x["target"] for x in got}
    assert abs(sum(goal.values()) - 1.5 * total) < 1e-6 and all(0 <= x["copies"] <= 2 for x in got)
    for s, t in goal.items():
        mine = [x for x in got if x["source"] == s]
        assert t <= 2 * mine[0]["source_size"] and abs(sum(x["size"] * x["copies"] for x in mine) - t) <= 31
    assert mixing.taken(mixing.mix_sources(df)).columns == df.columns
    assert mixing.mix_sources(df.where("false")).count() == 0


# ---- chat ----
def test_escape_is_reversible():
    for t in ["</s>[INST] ok [/INST]", "<|end|><\\|end|>", "<<SYS>> [\\INST] <\\\\/s>", "plain", "<|", "[[INST]]", "<<|text|>"]:
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(m in e for m in (chat.START, chat.SEP, chat.END, "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_packs_share_turns_and_read_back(spark):
    rows = []
    for c in range(60):
        rows += [(c, 0, "system", "same start"), (c, 1, "user", f"q{c % 7}"), (c, 2, "assistant", f"a<|end|>{c % 3}")]
    rows += [(70, 5, "assistant", None), (70, 2, None, "x\ny"), (None, 0, "user", "lost"), (71, 0, "assistant", "z" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packs = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.read_back(packs).collect()}
    for c in (0, 33, 70, 71, None):
        turns = [(r or "", t or "") for k, n, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for r, t in turns)) and got[c]["loss_sha256"] == sha(loss)
        assert (got[c]["n_turns"], got[c]["loss_chars"]) == (len(turns), len(loss))
    for p in packs.collect():
        assert p["text"].count("same start") <= 1
        for n in p["nodes"]:
            seen, at = set(), n
            while True:
                seen |= set(range(at["start"], at["end"]))
                if at["parent"] < 0:
                    break
                at = p["nodes"][at["parent"]]
            spans = [(x["start"], x["end"]) for x in n["attends"]]
            assert seen == {i for a, b in spans for i in range(a, b)} and all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
            if n["parent"] >= 0:
                up = p["nodes"][n["parent"]]
                assert n["position"] == up["position"] + up["end"] - up["start"]


def test_sql_of_mixing(spark):
    from winnowry.llm.queries import op9_source_mixing

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = c.sql(mixing.ORACLE + " ORDER BY doc_id").fetchall()
    got = op9_source_mixing(spark, DATA).orderBy("doc_id").select("doc_id", "size", "source_size", "target", "taken").collect()
    assert [tuple(r) for r in got] == want


def test_pipeline(spark):
    """Stage by stage on the smallest tables: decisions take effect, and clean documents stay."""
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "line dedup", "near dedup", "mix", "bpe"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    store = Scratch(spark, "t")
    out = [docs]
    for name, stage in p.STAGES:
        out.append(store.keep(stage(spark, out[-1], DATA), name.replace(" ", "-")))
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in out]
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").collect()}
    assert len(toxic & (ids[0] - ids[1])) >= 0.7 * len(toxic & ids[0]) and len(ids[0] - ids[1]) <= 2 * len(toxic) + 2
    assert ids[2] == ids[1] and all(d.columns == docs.columns for d in out[:5])
    texts = [r["text"] for r in out[2].orderBy("doc_id").select("text").collect()]
    assert out[3].count() == len({c if n else -i - 1 for i, (n, c) in enumerate(zip(*brute_near(texts, 5, 80), strict=True))})
    words = lambda d: d.select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert abs(words(out[4]) - 1.5 * words(out[3])) < 0.2 * words(out[3]) and out[5].count() == out[4].count()




def test_a_worker_gives_back_what_loading_took():
    """Executors have little room beside a grown heap: after the first texts a worker holds the tables, not the parsed file."""
    code = """
import re
import numpy, pyarrow, tokenizers
from winnowry.llm import bpe
from winnowry.llm.queries import vocabulary
own = lambda: int(re.search(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()).group(1)) / 1024
before = own()
list(bpe.encoded_texts(["some words"], vocabulary()))
print(own() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120)
    assert float(out.stdout) < 55
