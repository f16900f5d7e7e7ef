"""Odd rows for every operator: nulls, empty and long texts, repeated rows, empty tables, clashing column names."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from winnowry.llm import bpe, chat, fingerprint, line_dedup, media, mixing, near_dedup, packed, quality, queries, toxicity
from winnowry.llm.queries import vocabulary
from winnowry.llm.scratch import Scratch

DATA = "/root/testdata/sf0.1"
LONG = "one two three four five six seven " * 40_000


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, None, "a"), (2, "", None), (3, "some words here", "b"), (3, "some words here", "b"), (4, LONG, "a"), (None, "lost", "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    # names that the operators use inside
    return df.selectExpr("*", *[f"{i} AS `{c}`" for i, c in enumerate(("_text", "_row", "row", "value", "a0", "c0", "_media", "key", "id", "size", "check", "a.b"))])


def same_columns(before, after, added):
    assert after.columns == [c for c in before.columns if c not in added] + list(added)
    other = [c for c in before.columns if c not in ("doc_id", "text", "source", *added)]
    assert after.select(*[F.col(f"`{c}`") for c in other]).distinct().collect() == before.select(*[F.col(f"`{c}`") for c in other]).distinct().collect()


def test_tokens(spark, rows):
    added = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    out = bpe.encode(rows, vocabulary)
    same_columns(rows, out, added)
    got = sorted((r["doc_id"] or 0, r["text"] or "", r["n_tokens"], len(r["ids"])) for r in out.collect())
    assert [x[0] for x in got] == [0, 1, 2, 3, 3, 4] and all(x[2] == x[3] for x in got) and got[1][2] == got[2][2] == 0 and got[5][2] == 280_000
    assert bpe.encode(rows.where("false"), vocabulary).collect() == []
    again = bpe.encode(out, vocabulary, ids=False, decoded=False)
    assert again.columns == [c for c in out.columns if c not in added[:3]] + added[:3]
    replaced = bpe.encode(rows.select("doc_id", "text").withColumn("ids", F.lit(1)), vocabulary, text_col="text")
    assert dict(replaced.dtypes)["ids"] == "array<int>"


def test_toxicity_and_quality(spark, rows):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    twice = labels.unionByName(labels).unionByName(spark.createDataFrame([(None, 1, 1), (10**9, 1, 1)], labels.schema))
    model = toxicity.fit(docs, twice.select("doc_id", "toxic"))
    out = toxicity.score(rows, model)
    same_columns(rows, out, ["score"])
    assert out.where("score BETWEEN 0 AND 1").count() == 6 and toxicity.score(rows.where("false"), model).collect() == []
    by = {r["doc_id"]: r["score"] for r in out.collect()}
    assert by[1] == by[2] and out.where("doc_id = 3").select("score").distinct().count() == 1
    one, two = (toxicity.score(docs, toxicity.fit(docs, x.select("doc_id", "toxic"))).orderBy("doc_id").collect() for x in (labels, labels))
    assert one == two
    good = quality.fit(docs, twice.select("doc_id", "quality"))
    assert quality.score(rows, *good).where("score BETWEEN 0 AND 1").count() == 6 and quality.score(rows.where("false"), *good).collect() == []


def test_media(spark, rows, tmp_path):
    """Digests against the standard library; the tensor is what the file decodes to."""
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in queries.op5_media_columns(spark, str(tmp_path)).collect()}
    for i, t in ((1, ""), (2, ""), (3, "some words here"), (4, LONG), (None, "lost")):
        raw = t.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = out[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        (file,) = media.to_media([payload])
        assert r["media_bytes"] == len(file) and r["media_sha256"] == hashlib.sha256(file).hexdigest()
    assert out[1][1:] == out[2][1:]
    added = ["media", "payload", "height", "width", "rgb", "feature"]
    made = media.text_media(rows)
    same_columns(rows, made, added)
    again = media.tensors(made.select("doc_id", "media", "feature", F.col("rgb").alias("own"), F.lit(1).alias("_media")))
    for r in again.collect():
        assert r["rgb"] == r["own"] and len(r["rgb"]) == 3 * r["height"] * r["width"] > 0
        assert media.feature(np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)) == r["feature"]
    assert made.where("doc_id = 3").select("media").distinct().count() == 1
    assert media.text_media(rows.where("false")).collect() == media.tensors(made.where("false")).collect() == []


def spans(t):
    return {t[i : i + 8] for i in range(len(t) - 7)} or {t}


def test_fingerprint_likeness(spark):
    """The likeness follows the true Dice share of common 8-character spans."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) < 6000")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    off = []
    for k, i in enumerate(ids):
        t, n = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        for name, other in (("near_edited", t[: len(t) - half] + n[:half]), ("near_next", n)):
            a, b = spans(t), spans(other)
            off.append(abs(got[i][name] - 2 * len(a & b) / (len(a) + len(b))))
    assert np.mean(off) < 0.05 and np.quantile(off, 0.99) < 0.25


def test_fingerprints_of_odd_rows(spark, rows):
    out = fingerprint.fingerprints(rows)
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 5 and out.count() == 6 and got[4]["n_chars"] == len(LONG) and got[1]["fingerprint"] == got[2]["fingerprint"]
    assert fingerprint.fingerprints(rows.where("false")).collect() == []


def test_mixing(spark, rows):
    out = mixing.mix_sources(rows)
    assert out.count() == 6 and mixing.taken(out).columns == rows.columns
    assert out.where("row.doc_id = 4").first()["size"] == 280_000 and mixing.mix_sources(rows.where("false")).collect() == []


def test_chat(spark):
    said = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", LONG), (1, 1, "assistant", LONG), (2, 0, None, "")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(said.withColumn("nodes", F.lit(1)))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2 * len(LONG) and got[2]["n_turns"] == 1
    assert chat.read_back(chat.format_conversations(said.where("false"))).collect() == []


def test_near_and_lines(spark, rows):
    assert near_dedup.near_dedup(rows).columns == rows.columns
    assert sorted(r["doc_id"] or 0 for r in near_dedup.near_dedup(rows).collect()) == [0, 1, 2, 3, 3, 4]
    out = line_dedup.dedup_lines(rows)
    same_columns(rows, out, ["n_lines", "n_kept"])
    groups = {r["doc"]: (r["n"], r["component"]) for r in near_dedup.near_groups(rows, Scratch(spark, "t")).collect()}
    assert groups[1] == (0, 1) and groups[2] == (0, 2) and groups[None] == (1, None) and groups[4] == (7, 4)


@pytest.mark.parametrize("name", ["toxicity", "line dedup", "near dedup", "mix", "bpe"])
def test_pipeline_stages_of_odd_rows(spark, rows, name):
    import corpus_pipeline

    docs = rows.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"))
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, "/root/testdata/sf0.001")
    assert out.where("doc_id = 4").count() >= 1 and (name == "bpe" or out.columns == docs.columns)
    assert stage(spark, docs.where("false"), "/root/testdata/sf0.001").collect() == []


def held_out(spark, query, column, label):
    got = query(spark, DATA).where("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", F.col(label).alias("y")), "doc_id")
    return np.array([(r["score"], r["predicted"], r["y"]) for r in got.collect()], float)


def auc(score, y):
    order = np.argsort(np.argsort(score))
    p = y.sum()
    return (order[y == 1].sum() - p * (p - 1) / 2) / (p * (len(y) - p))


def test_held_out_toxicity(spark):
    """Labelled documents that were never learnt from; and neutral sentences that name a group stay clean."""
    x = held_out(spark, queries.op7_toxicity, "predicted", "toxic")
    assert len(x) > 500 and auc(x[:, 0], x[:, 2]) > 0.9
    assert x[x[:, 2] == 0, 1].mean() < 0.03 and x[x[:, 2] == 1, 1].mean() > 0.7
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic"))
    lines = [f"{a} {w} {b}" for w in toxicity.IDENTITY for a, b in (("many", "live in this town"), ("the", "family next door sings in the choir"), ("a book about", "history"))]
    scored = toxicity.score(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), model)
    assert scored.where("score >= 0.5").count() <= 0.02 * len(lines)


def test_held_out_quality(spark):
    x = held_out(spark, queries.op8_quality_classifier, "predicted", "quality")
    assert len(x) > 500 and auc(x[:, 0], x[:, 2]) > 0.9 and (x[:, 1] == x[:, 2]).mean() > 0.9


def test_documents_against_brute_force(spark):
    """Every link of the small table, through the query."""
    path = "/root/testdata/sf0.001"
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{path}/documents.parquet' ORDER BY doc_id").fetchall()
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in queries.op3_minhash_near_dedup(spark, path).collect()}
    for k, (i, _) in enumerate(texts):
        top = texts[find(k)][0]
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[k]), top, i == top)


def test_forgotten_words_are_encoded_again(monkeypatch):
    """Results are the library's whatever room the words have, in any order of texts."""
    import tokenizers

    monkeypatch.setattr(bpe, "_KEPT_BYTES", 2_000)
    library = tokenizers.Tokenizer.from_file(vocabulary())
    library.no_truncation()
    library.no_padding()
    texts = ["the cat's hat", "", "Ünïcode wörds, the cat", " ".join(f"w{i}x the" for i in range(300)), "<|endoftext|>the cat 12", "ã© é naïve THE Cat", "the cat's hat", "a\nb \tc"]
    words = bpe.Words(vocabulary())
    for _ in range(2):
        for t, (ids, said) in zip(texts, words.encoded([bpe._PIECE.findall(t) for t in texts]), strict=True):
            want = library.encode(t, add_special_tokens=False).ids
            assert ids == " ".join(map(str, want)) and said == library.decode(want, skip_special_tokens=False)
        assert words._size <= 2_000 and words._old


def test_pieces_met_before_are_not_cut_again(monkeypatch):
    """A piece is cut into words once as long as it is remembered; long pieces are not."""
    words = bpe.Words(vocabulary())
    cut, plain = [], bpe.TrieBpe.pieces
    monkeypatch.setattr(bpe.TrieBpe, "pieces", lambda self, piece: cut.append(piece) or plain(self, piece))
    texts = [bpe._PIECE.findall(t) for t in ("the cat's hat, Déjà-vu! \u6f22\u5b57 \u00a0", "The cat's <|endoftext|> " + "x" * 90)]
    first = list(words.encoded(texts))
    assert sorted(cut) == sorted(set().union(*texts))
    cut.clear()
    assert list(words.encoded(texts)) == first and set(cut) <= {"\u00a0", "x" * 90}


def test_small_inputs_are_spread_and_others_are_not(spark, tmp_path, monkeypatch):
    """One small file is dealt over the cores; enough files, enough bytes or rows from no file stay where they are."""
    docs = spark.range(100).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    docs.coalesce(1).write.parquet(f"{tmp_path}/one")
    docs.repartition(5).write.parquet(f"{tmp_path}/five")
    one, five = spark.read.parquet(f"{tmp_path}/one"), spark.read.parquet(f"{tmp_path}/five")
    assert packed.spread(five) is five and packed.spread(docs) is docs
    dealt = packed.spread(one)
    assert sorted(dealt.collect()) == sorted(one.collect())
    assert {r[0] for r in dealt.select(F.spark_partition_id()).collect()} == set(range(spark.sparkContext.defaultParallelism))
    monkeypatch.setattr(packed, "ROW_GROUP", 1)
    assert packed.spread(one) is one


def test_a_fit_gives_its_memory_back(tmp_path):
    """After the fit of many words the process holds little more than before; the most is a few copies of the word sets."""
    import subprocess
    import sys

    code = """
import re
import numpy as np
import pyarrow as pa
from winnowry.llm import packed, toxicity
held = lambda: sum(map(int, re.findall(r"\\nAnonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) >> 10
r = np.random.default_rng(1)
rows = lambda: pa.table({"id": range(6000), "y": [int(i % 9 == 0) for i in range(6000)], "set": [np.unique(r.integers(0, 90_000, 400)) for _ in range(6000)]})
toxicity._trained(rows().slice(0, 50))
packed.give_back()
before = held()
toxicity._trained(rows())
packed.give_back()
print(held() - before)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300)
    assert int(out.stdout) < 40
