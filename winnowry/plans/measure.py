"""Queries of aggregates, evaluation statistics and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text as T
from ..operators import audits as A
from ..operators import ordering as O
from ..operators import quality as U
from ..operators import selection as S
from ..operators import similarity as M
from ..operators import statistics as X
from ..operators import taste as P
from ..operators import tournament as C
from .registry import query, table

_GOLD = "WITH r AS (SELECT p_partkey, p_retailprice AS v, p_size <= 5 AS g, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS ord, count(*) OVER () AS n FROM part) "


def _gold(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("v"), (F.col("p_size") <= 5).alias("g"))
    return O.numbered(p, [F.desc("v"), F.col("p_partkey")], "ord")


@query("a4_group_counts", "SELECT count(*) AS groups, max(n) AS largest, sum(n)::BIGINT AS items FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def a4(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.max("n").alias("largest"), F.sum("n").alias("items"))


@query("a5_multi_groups", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS members FROM orders GROUP BY 1 HAVING count(*) >= 2")
def a5(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("members")).where(F.size("members") >= 2)


@query("a6_auc", "WITH x AS (SELECT p_size AS v, p_retailprice > 1500 AS g FROM part) SELECT coalesce(round(sum(CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0 END) / count(*), 9), 'nan'::DOUBLE) AS auc FROM x a, x b WHERE a.g AND NOT b.g")
def a6(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").alias("v"), (F.col("p_retailprice") > 1500).alias("g"))
    return X.auc(p, "v", "g").select(F.round("auc", 9).alias("auc"))


@query("a7_hits_at_k", _GOLD + "SELECT k, count(*) FILTER (g)::BIGINT AS hits FROM r, (SELECT unnest([10, 20, 50]) AS k) WHERE ord < k GROUP BY k")
def a7(spark, d):
    return X.hits(_gold(spark, d), "ord", "g", [10, 20, 50]).select("k", "hits")


@query("a8_lift", _GOLD + ", h AS (SELECT k, count(*) FILTER (g) AS hits, max(n) AS n FROM r, (SELECT unnest([10, 20, 30, 40, 50]) AS k) WHERE ord < k GROUP BY k) SELECT round(avg(hits / ((SELECT count(*) FROM r WHERE g) * k / n)), 9) AS lift FROM h")
def a8(spark, d):
    return X.hits(_gold(spark, d), "ord", "g", [10, 20, 30, 40, 50]).agg(F.round(F.avg("lift"), 9).alias("lift"))


_tail_udf = F.udf(X.hypergeometric_tail, DoubleType(), useArrow=False)  # one row for each report
_mcnemar_udf = F.udf(X.mcnemar, DoubleType(), useArrow=False)


@query("a9_hypergeometric", _GOLD + """, c AS (SELECT count(*) AS n, count(*) FILTER (g) AS gold, count(*) FILTER (g AND ord < 20) AS h FROM r),
f AS (SELECT n, gold, h, unnest(range(0, 21)) AS x FROM c)
SELECT round(sum(exp(lgamma(gold + 1) - lgamma(x + 1) - lgamma(gold - x + 1) + lgamma(n - gold + 1) - lgamma(20 - x + 1) - lgamma(n - gold - 20 + x + 1) - lgamma(n + 1) + lgamma(21) + lgamma(n - 19))), 6) AS p FROM f WHERE x >= h AND x <= gold""")
def a9(spark, d):
    c = _gold(spark, d).agg(F.count("*").alias("n"), F.count_if("g").alias("gold"), F.count_if(F.col("g") & (F.col("ord") < 20)).alias("h"))
    return c.select(F.round(_tail_udf("h", "n", "gold", F.lit(20)), 6).alias("p"))


_TAIL = "(SELECT round(sum(exp(lgamma({g} + 1) - lgamma(x + 1) - lgamma({g} - x + 1) + lgamma({n} - {g} + 1) - lgamma({k} - x + 1) - lgamma({n} - {g} - {k} + x + 1) - lgamma({n} + 1) + lgamma({k} + 1) + lgamma({n} - {k} + 1))), 4) FROM range(0, {k} + 1) t(x) WHERE x >= {h} AND x <= {g})"


@query("a10_report", _GOLD.replace("p_retailprice AS v,", "p_retailprice AS v, p_brand,") + """, top AS (SELECT g FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY ord) AS c FROM r) WHERE c <= 2 ORDER BY ord LIMIT 20),
c AS (SELECT count(*) AS n, count(*) FILTER (g) AS gold, count(*) FILTER (g AND ord < 20) AS h, (SELECT count(*) FILTER (g) FROM top) AS dh, (SELECT count(*) FROM top) AS dn FROM r),
u AS (SELECT sum(CASE WHEN a.v > b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0 END) / count(*) AS auc FROM r a, r b WHERE a.g AND NOT b.g),
l AS (SELECT avg(hits / (gold * k / n)) AS lift FROM (SELECT k, count(*) FILTER (r.g AND ord < k) AS hits FROM r, (SELECT unnest([10, 20, 30, 40, 50]) AS k) GROUP BY k), c)
SELECT round(auc, 4) AS auc, h AS hits, 20 AS k, n AS n_total, gold AS n_gold, round(gold * 20 / n, 2) AS random_expected, """ + _TAIL.format(g="gold", n="n", k="20", h="h") + " AS p_value, round(lift, 3) AS lift_mean, dh AS delivered_hits, dn AS delivered_n, " + _TAIL.format(g="gold", n="n", k="20", h="dh") + " AS delivered_p_value FROM c, u, l")
def a10(spark, d):
    r = _gold(spark, d).join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    return X.report(M.stored(r), "ord", "v", "g", 20, S.top_with_cap(r, "p_brand", [F.col("ord")], 20, 2))


@query("a11_holdout_curve")
def a11(spark, d):
    """Label 0 of the embeddings as the positives, all others as negatives: 200 splits for each size and protocol, against the first coordinate as the score."""
    return P.holdout_curve(table(spark, d, "embeddings").withColumn("base", F.col("embedding")[0]), "vec_id", "embedding", F.col("label") == 0, [2, 5, 10], baseline="base")


@query("a12_spearman", "WITH r AS (SELECT row_number() OVER (ORDER BY p_retailprice, p_partkey) AS a, row_number() OVER (ORDER BY p_size, p_partkey) AS b FROM part) SELECT round(corr(a, b), 9) AS rho FROM r")
def a12(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    p = O.numbered(p, [F.col("p_retailprice"), F.col("p_partkey")], "a")
    p = O.numbered(p, [F.col("p_size"), F.col("p_partkey")], "b")
    return p.agg(F.round(F.corr("a", "b"), 9).alias("rho"))


@query("a13_median_reference", """WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN p_brand || CASE WHEN p_partkey % 50 = 1 THEN 'x' || p_partkey ELSE '' END END AS f,
    CASE WHEN p_partkey % 13 > 0 AND NOT (p_partkey % 50 = 1) THEN (p_partkey * 7919 % 1000) / 10.0::DOUBLE END AS s,
    CASE WHEN p_size <= 5 THEN ['low_contrast', 'noise'] WHEN p_size > 40 THEN ['noise', 'low_sharpness'] ELSE [] END AS r FROM part),
m AS (SELECT f, median(s) AS m FROM x WHERE f IS NOT NULL GROUP BY f), a AS (SELECT median(s) AS a FROM x),
y AS (SELECT x.*, coalesce(m, a) AS ref, CASE WHEN m IS NULL THEN 0.35 ELSE 0.55 END AS share, list_filter(r, lambda v: v <> 'low_sharpness') AS rest FROM x LEFT JOIN m ON x.f = m.f, a)
SELECT p_partkey, CASE WHEN s IS NULL THEN array_to_string(r, ',') WHEN ref > 0 AND NOT list_contains(rest, 'low_contrast') AND s < ref * share THEN array_to_string(list_prepend('low_sharpness', rest), ',') ELSE array_to_string(rest, ',') END AS risks FROM y""")
def a13(spark, d):
    """Brands are families; every fifth part has none, some are alone in theirs and have no sharpness."""
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    family = F.when(k % 5 > 0, F.concat("p_brand", F.when(k % 50 == 1, F.concat(F.lit("x"), k.cast("string"))).otherwise("")))
    sharp = F.when((k % 13 > 0) & (k % 50 != 1), k * 7919 % 1000 / F.lit(10.0))
    risks = F.when(F.col("p_size") <= 5, F.array(F.lit("low_contrast"), F.lit("noise"))).when(F.col("p_size") > 40, F.array(F.lit("noise"), F.lit("low_sharpness"))).otherwise(none)
    p = table(spark, d, "part").select("p_partkey", family.alias("f"), sharp.alias("s"), risks.alias("r"))
    return U.sharpness_risks(p, "f", "s", "r").select("p_partkey", F.array_join("r", ",").alias("risks"))


_RULE = "WITH x AS (SELECT l.quality = 1 AS t, d.n_chars >= 500 AS p, d.lang FROM labels l JOIN documents d USING (doc_id)) "


def _rule(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return table(spark, d, "labels").join(docs, "doc_id").select((F.col("quality") == 1).alias("t"), (F.col("n_chars") >= 500).alias("p"), "lang")


@query("a14_confusion", _RULE + "SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (NOT t AND NOT p) AS tn, round(count(*) FILTER (t = p) / count(*), 9) AS accuracy FROM x")
def a14(spark, d):
    t, p = F.col("t"), F.col("p")
    return _rule(spark, d).agg(F.count_if(t & p).alias("tp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.round(F.try_divide(F.count_if(t == p), F.count("*")), 9).alias("accuracy"))


@query("a15_overlap", _GOLD + "SELECT count(*) FILTER (g AND ord < 50) AS overlap, round(50.0 * count(*) FILTER (g) / count(*), 6) AS expected, round(count(*) FILTER (g AND ord < n / 4) / count(*) FILTER (g), 6) AS top_quarter FROM r")
def a15(spark, d):
    r = _gold(spark, d)
    r = r.crossJoin(F.broadcast(r.agg(F.count("*").alias("n"))))
    return r.agg(F.count_if(F.col("g") & (F.col("ord") < 50)).alias("overlap"), F.round(F.count_if("g") * 50.0 / F.count("*"), 6).alias("expected"), F.round(F.try_divide(F.count_if(F.col("g") & (F.col("ord") < F.col("n") / 4)), F.count_if("g")), 6).alias("top_quarter"))


@query("a16_paired_table", _RULE + "SELECT lang, count(*) FILTER (t AND p) AS both, count(*) FILTER (t AND NOT p) AS only_a, count(*) FILTER (NOT t AND p) AS only_b, count(*) FILTER (NOT t AND NOT p) AS none FROM x GROUP BY ROLLUP (lang)")
def a16(spark, d):
    return X.paired_table(_rule(spark, d), "t", "p", "lang")


@query("a17_mcnemar", _RULE + """, c AS (SELECT count(*) FILTER (t AND NOT p) AS b, count(*) FILTER (NOT t AND p) AS c FROM x), k AS (SELECT b + c AS n, least(b, c) AS m FROM c)
SELECT round(least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 6) AS p FROM k, range(0, 100000) t(i) WHERE i <= m GROUP BY n""")
def a17(spark, d):
    return X.paired_table(_rule(spark, d), "t", "p").select(F.round(_mcnemar_udf("only_a", "only_b"), 6).alias("p"))


@query("a18_permutation", """WITH g AS (SELECT o_custkey, sum((o_totalprice > 150000)::INT - (o_orderstatus = 'F')::INT) AS d FROM orders GROUP BY 1),
o AS (SELECT sum(d) AS obs FROM g), s AS (SELECT r, sum(CASE WHEN substr(md5(o_custkey || '#' || r), 1, 1) < '8' THEN -d ELSE d END) AS s FROM g, range(2000) t(r) WHERE d <> 0 GROUP BY r)
SELECT max(obs)::BIGINT AS observed, round((count(*) FILTER (abs(s) >= abs(obs)) + 1) / 2001.0, 9) AS p_value FROM s, o""")
def a18(spark, d):
    o = table(spark, d, "orders").select("o_custkey", (F.col("o_totalprice") > 150000).alias("a"), (F.col("o_orderstatus") == "F").alias("b"))
    return X.permutation(o, "o_custkey", "a", "b", 2000).select("observed", F.round("p_value", 9).alias("p_value"))


@query("a19_tie_report", "WITH c AS (SELECT avg((event_type = 'view')::INT) AS tie, avg((value > 100)::INT) FILTER (event_type <> 'view') AS acc FROM events) SELECT round(tie, 6) AS tie_rate, round(acc, 6) AS accuracy, CASE WHEN acc > 0.55 THEN 'better' WHEN acc < 0.45 THEN 'worse' ELSE 'no difference' END AS verdict FROM c")
def a19(spark, d):
    tie = F.col("event_type") == "view"
    c = table(spark, d, "events").agg(F.avg(tie.cast("int")).alias("t"), F.avg(F.when(~tie, (F.col("value") > 100).cast("int"))).alias("a"))
    return c.select(F.round("t", 6).alias("tie_rate"), F.round("a", 6).alias("accuracy"), F.when(F.col("a") > 0.55, "better").when(F.col("a") < 0.45, "worse").otherwise("no difference").alias("verdict"))


@query("a20_detectable_effect", _RULE + "SELECT CASE WHEN count(*) FILTER (t <> p) >= 5 THEN round(2.8 * sqrt(count(*) FILTER (t <> p)) / count(*), 9) END AS effect FROM x")
def a20(spark, d):
    n = F.count_if(F.col("t") != F.col("p"))
    return _rule(spark, d).agg(F.when(n >= 5, F.round(F.sqrt(n) * 2.8 / F.count("*"), 9)).alias("effect"))


_RATE = "WITH c AS (SELECT event_type, count(*) FILTER (value > 100)::DOUBLE AS k, count(*)::DOUBLE AS n FROM events GROUP BY 1) "


@query("a22_wilson", _RATE + "SELECT event_type, round((k / n + 1.9208 / n - 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 9) AS lo, round((k / n + 1.9208 / n + 1.96 * sqrt(k / n * (1 - k / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n), 9) AS hi FROM c")
def a22(spark, d):
    c = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 100).alias("k"), F.count("*").alias("n"))
    lo, hi = X.wilson(F.col("k"), F.col("n"))
    return c.select("event_type", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


@query("a23_half_width", _RATE + "SELECT event_type, round(1.96 * sqrt(k / n * (1 - k / n) / n), 9) AS half FROM c")
def a23(spark, d):
    c = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 100).alias("k"), F.count("*").alias("n"))
    return c.select("event_type", F.round(X.half_width(F.col("k"), F.col("n")), 9).alias("half"))


_COND = "WITH p AS (SELECT user_id, event_type AS c, arg_min(round(value / 100)::INT, event_id) AS a FROM events GROUP BY 1, 2), w AS (SELECT user_id, max(a) FILTER (c = 'click') AS x, max(a) FILTER (c = 'view') AS y, max(a) FILTER (c = 'error') AS z FROM p GROUP BY 1) "


def _conditions(spark, d):
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "view", "error"])
    return p.agg(F.min_by(F.round(F.col("value") / 100).cast("int"), "event_id")).withColumnsRenamed({"click": "x", "view": "y", "error": "z"})


@query("a24_disagreement", _COND + "SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS pairs, round(avg((x <> y)::INT), 6) AS rate FROM w")
def a24(spark, d):
    return _conditions(spark, d).agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("pairs"), F.round(F.avg((F.col("x") != F.col("y")).cast("int")), 6).alias("rate"))


@query("a25_effects", _COND + "SELECT round(avg((x <> y)::INT), 6) AS noise, round(avg((x <> z)::INT) - avg((x <> y)::INT), 6) AS effect FROM w")
def a25(spark, d):
    r = lambda a, b: F.avg((F.col(a) != F.col(b)).cast("int"))
    return _conditions(spark, d).agg(F.round(r("x", "y"), 6).alias("noise"), F.round(r("x", "z") - r("x", "y"), 6).alias("effect"))


@query("a26_gates", _RATE + "SELECT event_type, k / n >= 0.79 AS passed FROM c")
def a26(spark, d):
    c = table(spark, d, "events").groupBy("event_type").agg(F.avg((F.col("value") > 100).cast("int")).alias("r"))
    gates = spark.createDataFrame([("click", 0.79), ("view", 0.79), ("error", 0.79), ("signup", 0.79), ("purchase", 0.79)], "event_type string, least double")
    return c.join(F.broadcast(gates), "event_type").select("event_type", (F.col("r") >= F.col("least")).alias("passed"))


@query("a27_marginals", "SELECT event_type, round(value / 100)::INT AS answer, count(*) AS n FROM events GROUP BY ALL")
def a27(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.round(F.col("value") / 100).cast("int").alias("answer")).agg(F.count("*").alias("n"))


@query("a28_calibration", """WITH x AS (SELECT event_id AS a, user_id AS b, CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' WHEN 'error' THEN 'tie' WHEN 'signup' THEN 'neither' WHEN 'purchase' THEN 'inconsistent' ELSE 'odd' END AS w, event_id % 17 = 3 AS sk, event_id % 3 > 0 AS firm, event_id % 5 > 0 AS ok, event_id % 41 = 0 AS con, CASE WHEN event_id % 4 = 3 AND event_id < 0 THEN NULL ELSE 'c' END AS code,
    CASE WHEN value > 100 THEN 'a' ELSE 'b' END AS ans FROM events)
SELECT count(*) AS n, count(*) FILTER (NOT sk AND w IN ('a', 'b') AND w = ans) AS gold, count(*) FILTER (NOT sk AND w IN ('a', 'b') AND w <> ans) AS other, count(*) FILTER (NOT sk AND w = 'neither') AS neither, count(*) FILTER (NOT sk AND w = 'tie') AS tie,
  count(*) FILTER (NOT sk AND w = 'inconsistent') AS inconsistent, count(*) FILTER (sk) AS skipped, count(*) FILTER (firm) AS consistent, round(count(*) FILTER (NOT sk AND w IN ('a', 'b') AND w = ans) / count(*) FILTER (NOT sk AND w IN ('a', 'b')), 9) AS hit_rate,
  round(count(*) FILTER (NOT sk AND w IN ('a', 'b', 'neither')) / count(*), 9) AS stated_rate, count(*) FILTER (ok) AS code_ok, count(*) FILTER (con) AS contradictions, 'other pairs,skipped pairs' || CASE WHEN count(*) FILTER (NOT sk AND w = 'odd') > 0 THEN ',unknown winners' ELSE '' END AS problems FROM x""")
def a28(spark, d):
    """The plan has one pair that never came, and one row is of a pair that was not planned."""
    e, k = table(spark, d, "events"), F.col("event_type")
    w = F.when(k == "click", "a").when(k == "view", "b").when(k == "error", "tie").when(k == "signup", "neither").when(k == "purchase", "inconsistent").otherwise("odd")
    i = F.col("event_id")
    rows = e.select(i.alias("a"), F.col("user_id").alias("b"), w.alias("winner"), (i % 17 == 3).alias("skipped"), (i % 3 > 0).alias("consistent"), F.lit("c").alias("code_a"), F.lit("d").alias("code_b"), (i % 5 > 0).alias("code_read_ok"), (i % 41 == 0).alias("contradiction"))
    plan = e.select(i.alias("a"), F.col("user_id").alias("b"), F.when(F.col("value") > 100, "a").otherwise("b").alias("answer"))
    plan = plan.where("a > 3").unionByName(plan.where("a <= 3").withColumn("b", F.when((F.col("a") == 3), F.lit(-1)).otherwise(F.col("b"))))
    c = A.calibration(rows, plan)
    return c.withColumns({"hit_rate": F.round("hit_rate", 9), "stated_rate": F.round("stated_rate", 9), "problems": F.array_join("problems", ",")})


@query("a29_retest", """WITH x AS (SELECT l_suppkey AS g, l_orderkey * 10 + l_linenumber AS i, bool_or(l_quantity > 25) AS x, bool_or(l_extendedprice > 30000) AS y FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY ALL),
p AS (SELECT a.g, a.x::INT - b.x::INT AS p, a.y::INT - b.y::INT AS q FROM x a JOIN x b ON a.g = b.g AND a.i < b.i),
c AS (SELECT g, count(*) FILTER (p = 0 AND q = 0) AS both_ties, count(*) FILTER ((p = 0) <> (q = 0)) AS one_tie, count(*) FILTER (p * q = 1) AS same_way, count(*) FILTER (p * q = -1) AS opposite FROM p GROUP BY g)
SELECT n.g AS l_suppkey, n, same, both_ties, one_tie, same_way, opposite FROM (SELECT g, count(*) AS n, count(*) FILTER (x = y) AS same FROM x GROUP BY g) n JOIN c ON n.g = c.g""")
def a29(spark, d):
    """Two rounds over the lines of each supplier; a third of them was judged in the first round only."""
    l = table(spark, d, "lineitem").groupBy("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("i"), "l_orderkey").agg(F.max(F.col("l_quantity") > 25).alias("x"), F.max(F.col("l_extendedprice") > 30000).alias("y"))
    return A.retest(l.withColumn("kept", F.col("x")), l.where("l_orderkey % 3 > 0").withColumn("kept", F.col("y")), "l_suppkey", "i", "kept")


@query("a30_local_baseline", "SELECT count(*) FILTER (a.o_orderpriority = '5-LOW' OR b.o_orderpriority = '5-LOW') AS gated, count(*) FILTER (a.o_totalprice > b.o_totalprice) AS first_better, count(*) AS n FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey")
def a30(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", (F.col("o_orderpriority") == "5-LOW").alias("low"))
    b = o.select("o_custkey", F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("low").alias("m"))
    p = o.join(b, "o_custkey").where("o_orderkey < k")
    return p.agg(F.count_if(F.col("low") | F.col("m")).alias("gated"), F.count_if(F.col("o_totalprice") > F.col("v")).alias("first_better"), F.count("*").alias("n"))


_RUN = "WITH r AS (SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, min(ts) AS t0, sum(value) AS cost FROM events GROUP BY user_id) "


def _runs(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.min("ts").alias("t0"), F.sum("value").alias("cost"))


@query("a33_latency", """WITH c AS (SELECT *, event_id % 3 + 2 AS images FROM events WHERE event_type <> 'error'),
g AS (SELECT event_type, median(value) AS p50, list_sort(list(value))[least(floor(count(*) * 0.9)::INT, count(*)::INT - 1) + 1] AS p90, max(value) AS worst, count(*) FILTER (value > 300) AS slow, count(*) AS sent FROM c GROUP BY event_type),
h AS (SELECT event_type, string_agg(images || ':' || n, ' ' ORDER BY images) AS images FROM (SELECT event_type, images, count(*) AS n FROM c GROUP BY ALL) GROUP BY event_type)
SELECT event_type, round(p50, 6) AS p50, round(p90, 6) AS p90, worst, slow, sent, images FROM g JOIN h USING (event_type)""")
def a33(spark, d):
    """Times of calls that did not fail, by kind, with how many images they had."""
    e = table(spark, d, "events").where("event_type <> 'error'").select("event_type", "value", (F.col("event_id") % 3 + 2).alias("images"))
    return X.latency(e, "event_type", "value", "images", 300).withColumns({"p50": F.round("p50", 6), "p90": F.round("p90", 6)})


@query("a34_group_summary", _RUN + """, x AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'A' WHEN user_id % 3 = 1 THEN 'B' ELSE 'C' END AS g, strftime(t0, '%m-%d') AS day, calls, errors - 1 AS net FROM r),
s AS (SELECT g, day, min(calls) AS lo, median(calls) AS mid, max(calls) AS hi, round(avg(calls), 6) AS mean, count(*) FILTER (net < 0) AS down, count(*) FILTER (net = 0) AS same, count(*) FILTER (net > 0) AS up, count(*) AS runs FROM x GROUP BY GROUPING SETS ((g), (g, day)))
SELECT *, CASE WHEN down = 0 THEN 'never worse' WHEN down <= 2 THEN 'sometimes worse' ELSE 'not advised' END AS bucket FROM s""")
def a34(spark, d):
    """Runs of three groups, each as a whole (day null) and by day."""
    u = F.col("user_id") % 3
    r = _runs(spark, d).select(F.when(u == 0, "A").when(u == 1, "B").otherwise("C").alias("g"), F.date_format("t0", "MM-dd").alias("day"), "calls", (F.col("errors") - 1).alias("net"))
    return X.group_summary(r, "g", "day", "calls", "net").withColumn("mean", F.round("mean", 6))


@query("a35_list_overlap", "WITH l AS (SELECT c_nationkey AS g, c_custkey % 7 AS run, list(DISTINCT c_mktsegment) AS s FROM customer GROUP BY ALL) SELECT a.g, a.run AS i, b.run AS j, len(list_intersect(a.s, b.s)) AS n FROM l a JOIN l b ON a.g = b.g AND a.run < b.run")
def a35(spark, d):
    l = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("g"), (F.col("c_custkey") % 7).alias("run")).agg(F.collect_set("c_mktsegment").alias("s"))  # noqa: E741
    b = l.select("g", F.col("run").alias("j"), F.col("s").alias("t"))
    return l.withColumnRenamed("run", "i").join(b, "g").where("i < j").select("g", "i", "j", F.size(F.array_intersect("s", "t")).cast("long").alias("n"))


@query("a36_pair_report", "SELECT l_suppkey, l_linenumber, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS correct, count(DISTINCT l_quantity) AS distinct_values FROM lineitem GROUP BY ALL")
def a36(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("correct"), F.count_distinct("l_quantity").alias("distinct_values"))


@query("a37_daily", "SELECT strftime(ts, '%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def a37(spark, d):
    return table(spark, d, "events").groupBy(F.date_format("ts", "MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("a38_code_read", "WITH x AS (SELECT CASE WHEN event_type = 'error' THEN 'missing' WHEN event_type = 'signup' THEN 'not shown' ELSE 'judged' END AS s, value FROM events) SELECT s AS state, count(*) AS n, round(avg((value > 50)::INT) FILTER (s = 'judged'), 6) AS rate FROM x GROUP BY s")
def a38(spark, d):
    k = F.col("event_type")
    s = F.when(k == "error", "missing").when(k == "signup", "not shown").otherwise("judged")
    return table(spark, d, "events").select(s.alias("state"), "value").groupBy("state").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("state") == "judged", (F.col("value") > 50).cast("int"))), 6).alias("rate"))


@query("a40_verdict_accounting", """WITH asked AS (SELECT l_orderkey AS a, l_partkey AS b FROM lineitem), v AS (SELECT l_partkey AS a, l_orderkey AS b FROM lineitem WHERE l_suppkey % 3 = 0 UNION SELECT o_orderkey, -1 FROM orders),
s AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM v UNION ALL SELECT b, a FROM v)), c AS (SELECT count(s.a) AS used, count(*) - count(s.a) AS missing FROM asked LEFT JOIN s USING (a, b))
SELECT 'replay' AS judge, used, missing, (SELECT count(*) FROM v) - used AS unused FROM c UNION ALL SELECT 'local', NULL, NULL, NULL""")
def a40(spark, d):
    """Verdicts of a third of the pairs, in the other order, and some of pairs that nobody asked about; a local judge has no account."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b"), "l_suppkey")
    paid = l.where("l_suppkey % 3 = 0").selectExpr("b AS a", "a AS b").unionByName(table(spark, d, "orders").selectExpr("o_orderkey AS a", "CAST(-1 AS BIGINT) AS b")).distinct()
    one = A.accounting(l, paid).withColumn("judge", F.lit("replay"))
    return one.unionByName(A.accounting(l, None).withColumn("judge", F.lit("local")))


_CELLS = """WITH x AS (SELECT CASE WHEN event_id % 5 < 3 THEN 'primary' ELSE 'equal' END AS tag, CASE user_id % 7 WHEN 0 THEN 'bare' WHEN 1 THEN 'rules' ELSE 'examples' END AS arm, event_id, user_id, event_type, value FROM events WHERE event_type <> 'error') """
_ARMS = ["bare", "rules", "examples", "none"]


def _cells(spark, d):
    arm = F.when(F.col("user_id") % 7 == 0, "bare").when(F.col("user_id") % 7 == 1, "rules").otherwise("examples")
    return table(spark, d, "events").where("event_type <> 'error'").withColumns({"tag": F.when(F.col("event_id") % 5 < 3, "primary").otherwise("equal"), "arm": arm})


@query("a42_coverage", _CELLS + """, g AS (SELECT * FROM (VALUES ('primary', 900), ('equal', 0)) t(tag, want), (VALUES ('bare'), ('rules'), ('examples'), ('none')) a(arm)),
c AS (SELECT g.tag, g.arm, want, count(x.tag) AS n, count(*) FILTER (event_type = 'signup') AS lacks, count(*) FILTER (event_id % 3 = 0) AS firm FROM g LEFT JOIN x ON g.tag = x.tag AND g.arm = x.arm GROUP BY ALL)
SELECT tag, arm, 'pairs' AS "check", n, n = want AS ok FROM c UNION ALL SELECT tag, arm, 'directions', lacks, lacks = 0 FROM c UNION ALL SELECT tag, arm, 'consistent', firm, true FROM c""")
def a42(spark, d):
    """Signups lack an answer in one order; one arm has no rows at all."""
    r = _cells(spark, d).select("tag", "arm", F.col("event_type").alias("ab"), F.when(F.col("event_type") != "signup", "x").alias("ba"), (F.col("event_id") % 3 == 0).alias("consistent"))
    want = r.select("tag").distinct().withColumn("n", F.when(F.col("tag") == "primary", 900).otherwise(0))
    return A.coverage(r, want, _ARMS)


@query("a43_duplicate_texts", "WITH f AS (SELECT doc_id, md5(list_aggregate(list_sort(list_transform(string_split(text, chr(10)), lambda p: md5(p))), 'string_agg', '|')) AS h FROM documents WHERE text IS NOT NULL) SELECT h, count(*) AS n, min(doc_id) AS first FROM f GROUP BY 1 HAVING count(*) > 1")
def a43(spark, d):
    """Documents of the same lines, in whatever order."""
    f = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", T.content_fingerprint(F.split("text", "\n", -1)).alias("h"))
    return f.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("a44_set_index", "SELECT r_name, count(*) AS n, substr(sha256(string_agg(n_name, chr(10) ORDER BY n_name) || chr(10)), 1, 16) AS h FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def a44(spark, d):
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey")), "n_regionkey")
    return n.groupBy("r_name").agg(F.count("*").alias("n"), T.fingerprint(F.collect_list("n_name")).alias("h"))


@query("a45_rounded_margin", "SELECT s_nationkey, round_even(max(s_acctbal) - min(s_acctbal), 6) AS margin, count(*) AS n FROM supplier GROUP BY 1")
def a45(spark, d):
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(F.bround(F.max("s_acctbal") - F.min("s_acctbal"), 6).alias("margin"), F.count("*").alias("n"))


@query("a46_progress", "SELECT event_type, count(*) AS done, round(count(*) / (SELECT count(*) FROM events), 9) AS share, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 300 SECOND AS idle FROM events GROUP BY 1")
def a46(spark, d):
    e = table(spark, d, "events")
    all_ = e.agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    g = e.groupBy("event_type").agg(F.count("*").alias("done"), F.max("ts").alias("t")).crossJoin(F.broadcast(all_))
    return g.select("event_type", "done", F.round(F.col("done") / F.col("n"), 9).alias("share"), (F.col("t") < F.col("last") - F.expr("INTERVAL 300 SECONDS")).alias("idle"))


@query("a47_grouped_items", "SELECT count(DISTINCT o_custkey) AS groups, count(*) AS items FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) >= 2)")
def a47(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 2")
    return g.agg(F.count("*").alias("groups"), F.sum("n").alias("items"))


@query("a48_sensitivity", "WITH a AS (SELECT s_nationkey AS seg, arg_max(s_suppkey, (s_acctbal, -s_suppkey)) AS x FROM supplier GROUP BY 1), b AS (SELECT s_nationkey AS seg, max(s_suppkey) AS y FROM supplier WHERE s_acctbal > 0 GROUP BY 1) SELECT coalesce(a.seg, b.seg) AS seg, x, y FROM a FULL JOIN b ON a.seg = b.seg WHERE x IS DISTINCT FROM y")
def a48(spark, d):
    s = table(spark, d, "supplier")
    a = s.groupBy(F.col("s_nationkey").alias("seg")).agg(F.max_by("s_suppkey", F.struct("s_acctbal", -F.col("s_suppkey"))).alias("x"))
    b = s.where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("seg")).agg(F.max("s_suppkey").alias("y"))
    return a.join(b, "seg", "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("seg", "x", "y")


@query("a49_completeness", "SELECT count(*) FILTER (quality IS NULL) AS no_quality, count(*) FILTER (toxic IS NULL) AS no_toxic, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM documents)) AS no_text FROM labels")
def a49(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.lit(True).alias("t"))
    l = table(spark, d, "labels").join(docs, "doc_id", "left")  # noqa: E741
    return l.agg(F.count_if(F.col("quality").isNull()).alias("no_quality"), F.count_if(F.col("toxic").isNull()).alias("no_toxic"), F.count_if(F.col("t").isNull()).alias("no_text"))


@query("a50_drift_tier", "SELECT d.lang, CASE WHEN avg((quality <> toxic)::INT) >= 0.9 THEN 'stable' WHEN avg((quality <> toxic)::INT) >= 0.8 THEN 'watch' ELSE 'drift' END AS tier FROM labels JOIN documents d USING (doc_id) GROUP BY 1")
def a50(spark, d):
    r = F.avg((F.col("quality") != F.col("toxic")).cast("int"))
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return x.groupBy("lang").agg(F.when(r >= 0.9, "stable").when(r >= 0.8, "watch").otherwise("drift").alias("tier"))


@query("a51_arms_differ", """WITH x AS (SELECT l_returnflag AS tag, l_orderkey AS a, l_partkey AS b, min(l_suppkey % 4) AS s, min(l_linenumber) AS ln FROM lineitem GROUP BY ALL),
r AS (SELECT tag, a, b, 'bare' AS arm, s AS w FROM x UNION ALL SELECT tag, a, b, 'rules', s FROM x WHERE ln < 6 UNION ALL SELECT tag, a, b, 'examples', CASE WHEN ln = 1 THEN 9 ELSE s END FROM x),
p AS (SELECT * FROM (VALUES ('bare', 'rules'), ('bare', 'examples'), ('bare', 'none'), ('rules', 'examples'), ('rules', 'none'), ('examples', 'none')) t(one, two)), t AS (SELECT DISTINCT tag FROM x),
c AS (SELECT t.tag, p.one, p.two, count(y.w) AS common, count(*) FILTER (x.w = y.w) AS same FROM t CROSS JOIN p LEFT JOIN r x ON x.tag = t.tag AND x.arm = p.one LEFT JOIN r y ON y.tag = x.tag AND y.a = x.a AND y.b = x.b AND y.arm = p.two GROUP BY ALL)
SELECT tag, one, two, same, common, common = 0 OR same < common AS differ FROM c""")
def a51(spark, d):
    """The second arm answers what the first one does on all pairs that it has; the third differs on first lines; a fourth has no rows."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("tag"), F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")).agg(F.min(F.col("l_suppkey") % 4).alias("s"), F.min("l_linenumber").alias("n"))
    arm = lambda name, rows, w: rows.select("tag", "a", "b", F.lit(name).alias("arm"), w.cast("string").alias("winner"))
    r = arm("bare", x, F.col("s")).unionByName(arm("rules", x.where("n < 6"), F.col("s"))).unionByName(arm("examples", x, F.when(F.col("n") == 1, 9).otherwise(F.col("s"))))
    return A.arms_differ(r, _ARMS)


@query("q9_plan_handshake", """WITH o AS (SELECT o_custkey AS g, o_orderkey AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders),
plan AS (SELECT a.x AS a, b.x AS b, row_number() OVER (ORDER BY a.m DESC, a.g) AS pos FROM o a JOIN o b ON a.g = b.g AND a.n = 1 AND b.n = 2 ORDER BY a.m DESC, a.g LIMIT 24),
v AS (SELECT b AS a, a AS b FROM plan WHERE pos % 4 > 0 UNION ALL SELECT (SELECT a FROM plan WHERE pos = 1), (SELECT b FROM plan WHERE pos = 2))
SELECT count(*) FILTER (v.a IS NOT NULL) AS used, count(*) FILTER (v.a IS NULL) AS missing, 1::BIGINT AS unused, (SELECT md5('[' || string_agg('["' || a || '","' || b || '"]', ',' ORDER BY pos) || ']') FROM plan) AS hash
FROM plan LEFT JOIN v ON v.a = plan.b AND v.b = plan.a""")
def q9(spark, d):
    """A budget of 24 matches, one for each of the largest groups; verdicts come in the other order, and one of them was not planned."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("n"))
    top = o.groupBy("o_custkey").agg(F.count("*").alias("m"), F.max(F.when(F.col("n") == 1, F.col("o_orderkey"))).alias("a"), F.max(F.when(F.col("n") == 2, F.col("o_orderkey"))).alias("b")).where("m > 1")
    few = top.orderBy(F.desc("m"), "o_custkey").limit(24)
    plan = M.stored(few.select("a", "b", F.row_number().over(Window.orderBy(F.desc("m"), "o_custkey")).alias("pos")))
    said = plan.where("pos % 4 > 0").selectExpr("b AS a", "a AS b", "'a' AS winner")
    other = plan.where("pos <= 2").agg(F.max(F.when(F.col("pos") == 1, F.col("a"))).alias("a"), F.max(F.when(F.col("pos") == 2, F.col("b"))).alias("b")).withColumn("winner", F.lit("tie"))
    hashed = C.plan_hash(plan)
    return C.handshake(plan, hashed.first()["hash"], said.unionByName(other)).crossJoin(F.broadcast(hashed))


@query("q18_probe")
def q18(spark, d):
    """A probe for each of the ten labels against all others, and its probability for every vector."""
    return P.probe_scores(table(spark, d, "embeddings"), "vec_id", "embedding", "label", list(range(10)))


@query("q19_proposal", "WITH p AS (SELECT o_custkey, list(o_orderkey) AS l, count(*) AS n, count(DISTINCT o_orderstatus) AS k, bool_or(o_totalprice < 1000) AS low FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN n = 0 THEN 'empty' WHEN low THEN 'not active' WHEN k < n THEN 'one per family' WHEN n > 20 THEN 'over target' ELSE 'ok' END AS verdict FROM p")
def q19(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderstatus").alias("k"), F.max(F.col("o_totalprice") < 1000).alias("low"))
    return g.select("o_custkey", F.when(F.col("n") == 0, "empty").when(F.col("low"), "not active").when(F.col("k") < F.col("n"), "one per family").when(F.col("n") > 20, "over target").otherwise("ok").alias("verdict"))


@query("q20_active_pool", "WITH c AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1) SELECT o_orderkey FROM orders JOIN c USING (o_custkey) WHERE o_totalprice = top OR o_custkey % 2 = 1")
def q20(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    top = o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    gone = o.join(top, "o_custkey").where("o_totalprice < top AND o_custkey % 2 = 0").select("o_orderkey")
    return o.select("o_orderkey").join(gone, "o_orderkey", "left_anti")
