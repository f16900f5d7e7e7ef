"""Queries of sources, caches, readers and logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import files as S
from ..streaming import live as L
from ..streaming import ordered as W
from ..streaming import progress as P
from ..operators import ordering as O
from ..operators.stored import shared_folder
from .registry import query, table


@query("s1_listing", "SELECT page_id, url FROM pages WHERE NOT (regexp_replace(url, '^https?://', '') LIKE 'www.%') ")
def s1(spark, d):
    rel = F.regexp_replace("url", "^https?://", "")
    hosts = table(spark, d, "pages").select("page_id", "url", rel.alias("rel"), F.substring_index(rel, "/", 1).alias("host"))
    return hosts.where(~S.excluded(F.when(F.col("rel").startswith("www."), F.lit("www")).otherwise(F.col("rel")), ["www"])).select("page_id", "url")


@query("s2_natural_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS r FROM part")
def s2(spark, d):
    name = F.concat(F.lit("img"), F.col("p_partkey").cast("string"), F.lit(".jpg"))
    p = table(spark, d, "part").select("p_partkey", T.natural_key(name).alias("k"))
    return O.numbered(p, [F.col("k")], "r", 1).select("p_partkey", "r")


@query("s4_fingerprint", "SELECT n_regionkey, substr(sha256(string_agg(n_name || '|' || n_nationkey, chr(10) ORDER BY n_name || '|' || n_nationkey) || chr(10)), 1, 16) AS fp FROM nation GROUP BY 1")
def s4(spark, d):
    line = F.concat_ws("|", "n_name", F.col("n_nationkey").cast("string"))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(T.fingerprint(F.collect_list(line)).alias("fp"))


@query("s5_missing_entries", "SELECT md5(html) AS k, min(CASE WHEN page_id % 3 = 0 THEN 1 ELSE 2 END) AS round, min(length(html))::BIGINT AS size FROM pages WHERE html IS NOT NULL GROUP BY 1")
def s5(spark, d):
    """A cache built for a third of the pages and then for all: what the first round made is not made again."""
    k = table(spark, d, "pages").where("html IS NOT NULL").select("page_id", F.md5("html").alias("k"), "html")
    of = lambda rows: rows.groupBy("k").agg(F.min("html").alias("html"))
    make = lambda n: lambda rows: rows.select("k", F.lit(n).alias("round"), F.char_length("html").cast("long").alias("size"))
    path = f"{shared_folder(spark)}/winnowry/cache-{uuid.uuid4().hex}"
    S.build_cache(of(k.where("page_id % 3 = 0")), path, "k", make(1))
    return S.build_cache(of(k), path, "k", make(2))


@query("s6_cache_valid", """WITH c AS (SELECT unnest([8, 9, 10]) AS below), n AS (SELECT below, count(*) FILTER (label < below) AS cached, count(*) AS wanted FROM embeddings, c GROUP BY below) SELECT below, cached = wanted AS valid FROM n""")
def s6(spark, d):
    """A cache of the vectors with a label below 8, 9 and 10: only the last one is whole."""
    e = table(spark, d, "embeddings")
    return spark.createDataFrame([(k, S.cache_valid(e, e.where(F.col("label") < k), "vec_id")) for k in (8, 9, 10)], "below int, valid boolean")


@query("s8_facts", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def s8(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("s10_known_lines", "SELECT DISTINCT lower(trim(source)) AS item FROM documents WHERE lower(trim(source)) IN ('src1', 'src2', 'src300')")
def s10(spark, d):
    names = spark.createDataFrame([(" src1 ",), ("src2",), ("",), ("src300",)], "item string").select(F.trim("item").alias("item")).where("length(item) > 0")
    return table(spark, d, "documents").select(F.lower(F.trim("source")).alias("item")).distinct().join(names, "item", "left_semi")


@query("st2_finished", "SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 4")
def st2(spark, d):
    return P.finished(table(spark, d, "events"), "user_id", 4)


@query("st5_bursts", """WITH x AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS l FROM events),
b AS (SELECT *, sum(CASE WHEN l IS NULL OR t - l > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS b FROM x)
SELECT user_id, min(t) AS start, max(t) AS "end", count(*) AS n FROM b GROUP BY user_id, b""")
def st5(spark, d):
    return P.bursts(table(spark, d, "events"), "user_id", "ts", 7200)


@query("st1_status", """WITH c AS (SELECT user_id AS run, count(*) AS done, max(ts) AS last FROM events GROUP BY 1), p AS (SELECT c_custkey AS run, 1 + c_custkey % 15 AS total FROM customer WHERE c_custkey % 4 <> 0),
n AS (SELECT max(ts) AS now FROM events)
SELECT coalesce(p.run, c.run)::VARCHAR AS run, coalesce(done, 0) AS done, total, epoch_us(last) AS last,
       CASE WHEN total > 0 AND coalesce(done, 0) >= total THEN 'done' WHEN coalesce(done, 0) = 0 THEN 'waiting' WHEN epoch_us(now) - epoch_us(last) > 7200000000 THEN 'idle' ELSE 'running' END AS status
FROM p FULL JOIN c ON p.run = c.run, n""")
def st1(spark, d):
    """Users as runs with planned numbers of events, at the time of the last event; two hours without one are idle."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run"), "ts")
    plan = table(spark, d, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").cast("string").alias("run"), (F.col("c_custkey") % 15 + 1).alias("total"))
    now = F.lit(e.agg(F.max("ts").cast("timestamp")).first()[0])
    return L.statuses(e.withColumn("ts", F.col("ts").cast("timestamp")), plan, now, 7_200).withColumn("last", F.unix_micros("last"))


@query("st4_sequence_report", """WITH l AS (SELECT l_orderkey AS k, l_linenumber::BIGINT - 1 AS i, l_partkey AS p, l_suppkey AS s FROM lineitem),
d AS (SELECT k, i, p, s, 0 AS n FROM l WHERE p % 7 <> 0 UNION ALL SELECT k, i, p, s, 1 FROM l WHERE p % 7 <> 0 AND p % 11 = 0 UNION ALL SELECT k, i, p, s + 1, -1 FROM l WHERE p % 13 = 5),
w AS (SELECT k, i, min(s) AS s FROM l GROUP BY ALL),
r AS (SELECT d.k, d.i, row_number() OVER (PARTITION BY d.k, d.i ORDER BY d.n, d.p, d.s) AS turn, d.s IS DISTINCT FROM w.s AS bad FROM d LEFT JOIN w ON d.k = w.k AND d.i = w.i),
g AS (SELECT k, i, coalesce(lag(i) OVER (PARTITION BY k ORDER BY i), -1) AS before FROM r WHERE turn = 1)
SELECT k, i, i AS until, CASE WHEN turn > 1 THEN 'repeat' ELSE 'mismatch' END AS status FROM r WHERE turn > 1 OR bad
UNION ALL SELECT k, before + 1, i - 1, 'gap' FROM g WHERE before + 1 < i""")
def st4(spark, d):
    """Order lines as a log of numbered calls: some are lost, some come twice, and some answer another question than the plan's."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber").cast("long") - 1).alias("i"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    kept = l.where("p % 7 <> 0")
    log = kept.withColumn("n", F.lit(0)).unionByName(kept.where("p % 11 = 0").withColumn("n", F.lit(1)))
    log = log.unionByName(l.where("p % 13 = 5").withColumn("s", F.col("s") + 1).withColumn("n", F.lit(-1)))
    plan = l.groupBy("k", "i").agg(F.min("s").alias("s"))
    return W.sequence_report(log, "k", "i", F.struct("n", "p", "s"), plan, ["s"])
