"""Importance resampling towards a target distribution, over hashed word n-grams.

Documents and target texts are bags of hashed n-grams.  A bucket's gain is the logarithm of its
smoothed share of the target over its share of the documents; a document's weight is the sum of the gains of its
features, and noise of its own (Gumbel, from a hash of its id) turns weights into scores of which the
highest are a sample without replacement.

Equal texts are collapsed first: documents are grouped by their full text, each group is cut into features and
weighed once, and its features count as often as it has copies.  The weights go back to the documents by a digest of the text, and
the noise comes after that, as it belongs to the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .counted import join_counted
from .mixing import prefix_sums
from .packed import column
from .scratch import Scratch

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def features(w: Column, longest: int = 1, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to ``longest`` words of an array, repeats included."""

    def runs(k: int) -> Column:
        starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return w if k == 1 else F.transform(starts, lambda i: F.array_join(F.slice(w, i, k), " "))

    return F.transform(F.concat(*[runs(k) for k in range(1, longest + 1)]), lambda x: (F.crc32(x.cast("binary")) % buckets).cast("int"))


def gains(have: DataFrame, want: DataFrame, buckets: int) -> list[int]:
    """The gain of every bucket, in thousandths, from (bucket, c) of the documents and of the target."""
    s = have.groupBy("bucket").agg(F.sum("c").alias("s"))
    t = want.groupBy("bucket").agg(F.sum("c").alias("t"))
    both = have.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left")
    both = both.select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("s", "t")])
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    rows = both.crossJoin(F.broadcast(total)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).orderBy("bucket").collect()
    return [r["gain"] for r in rows]


def weighted(
    docs: DataFrame, target: DataFrame, store: Scratch, text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = BUCKETS
) -> DataFrame:
    """Rows (k1, k2, copies, n_features, n_words, weight), one for each distinct text; k1 and k2 are its digest.

    The gains, one number for each of ``buckets``, are all that passes the driver.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    distinct = docs.select(text).groupBy("text").agg(F.count("*").alias("copies"))
    cut = distinct.select(*digest("text"), "copies", words(F.col("text")).alias("w"))
    made = cut.select("k1", "k2", "copies", F.size("w").cast("long").alias("n_words"), features(F.col("w"), longest, buckets).alias("buckets"))
    made = store.keep(made, "features")
    have = made.select(F.explode("buckets").alias("bucket"), "copies").groupBy("bucket").agg(F.sum("copies").alias("c"))
    want = target.select(words(F.col(target_col)).alias("w")).select(F.explode(features(F.col("w"), longest, buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("c"))
    gain = F.split(F.lit(",".join(map(str, gains(have, want, buckets)))), ",").cast("array<bigint>")
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda a, b: a + F.get(gain, b))
    n = F.size("buckets").cast("long").alias("n_features")
    out = store.keep(made.select("k1", "k2", "copies", n, "n_words", weight.alias("weight")), "weights")
    store.drop(made)
    return out


def digest(text: str) -> list[Column]:
    """Two columns, k1 and k2, that are 128 bits of the SHA-256 of a text."""
    hexed = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    # 60 bits and 60 bits fit signed values
    return [F.conv(F.substring(hexed, p, 15), 16, 10).cast("long").alias(n) for n, p in (("k1", 1), ("k2", 16))]


def noise(ident: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def importance_resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    longest: int = 1,
    buckets: int = BUCKETS,
    seed: int = 2024,
    percent: int = 10,
    least_words: int = 20,
    slim: bool = False,
) -> DataFrame:
    """All documents with n_features, weight, score and rank; rank is 1, 2, ... for those drawn, else null.

    ``percent`` of the documents with ``least_words`` words or more are drawn, those of the highest scores; ties go to smaller
    ids.  ``slim`` leaves the texts out.

    Defined cases: a null or empty text has no features and weight 0; a null id has the noise of the empty id and goes last among equal
    scores; repeated rows have equal scores and places one after another; without target texts, or without documents, counts are 0 and only smoothing is
    left; no rows give no rows.  All other columns pass through; columns named like the new ones are replaced.
    """
    spark = docs.sparkSession
    store = Scratch(spark, "resample")
    texts = weighted(docs, target, store, text_col, target_col, longest, buckets)
    made = ("n_features", "weight", "score", "rank")
    whole = [(i, c) for i, c in enumerate(docs.columns) if c not in made and not (slim and c == text_col)]
    row = F.struct(F.lit(0).alias("_"), *[column(c).alias(f"c{i}") for i, c in whole]).alias("row")
    rows = store.keep(docs.select(row, F.col(id_col).alias("id"), *digest(text_col)), "rows")
    scored = join_counted(rows, texts, ["k1", "k2"], "copies")
    scored = scored.select("row", "id", "n_features", "weight", (F.col("n_words") >= least_words).alias("may"), (F.col("weight") + noise(F.col("id"), seed)).alias("score"))
    scored = store.keep(scored, "scored")
    drawn = (scored.agg(F.count_if("may")).first()[0] * percent) // 100
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranked = prefix_sums(scored.where("may"), store, [], [F.desc("score"), F.asc_nulls_last("id")], {"place": F.lit(1).cast("long")}, parts)
    ranked = ranked.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place")
    out = ranked.unionByName(scored.where(~F.col("may")).withColumn("rank", F.lit(None).cast("long")))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in whole], *made)


#: DuckDB SQL of the digest query; crc32 is stepped byte by byte over a table made by its rule.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
texts AS (SELECT doc_id, text, 0 AS side FROM documents UNION ALL SELECT item_id, text, 1 FROM benchmark),
w AS (
  SELECT side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM texts),
v AS (SELECT DISTINCT w FROM w),
hx AS (SELECT w, hex(encode(w)) AS h FROM v),
octets AS (SELECT w, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM hx),
crc AS (SELECT w, (xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 10000)::INT AS bucket FROM octets, tab),
f AS (SELECT side, doc_id, bucket FROM w JOIN crc USING (w)),
n AS (SELECT count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f),
g AS (
  SELECT b.bucket, floor(1000 * ln((coalesce(x.t, 0) + 1)::DOUBLE * (n.s + 10000)::DOUBLE / ((coalesce(x.s, 0) + 1)::DOUBLE * (n.t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM (SELECT i::INT AS bucket FROM range(10000) r(i)) b
  LEFT JOIN (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f GROUP BY bucket) x USING (bucket), n),
d AS (
  SELECT o.doc_id, coalesce(z.nf, 0)::BIGINT AS n_features, coalesce(z.weight, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || o.doc_id::VARCHAR), 1, 8))::BIGINT AS h
  FROM documents o LEFT JOIN (SELECT doc_id, count(*) AS nf, sum(gain) AS weight FROM f JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id) z ON o.doc_id = z.doc_id),
s AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (n * 10) // 100 THEN place END AS rank FROM r
"""
