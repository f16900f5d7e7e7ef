"""Queries of predicates, joins, windows, set operations, tournaments and selection."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranks as R
from ..functions import text as T
from ..operators import audits as A
from ..operators import components as G
from ..operators import nearest as N
from ..operators import ordering as O
from ..operators import selection as S
from ..operators import similarity as M
from ..operators import tournament as C
from .registry import query, table
from .scalar import _PX, _px

_ORD = """WITH b AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS seq, count(*) OVER () AS n FROM orders),
w AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS wr, least(seq * 10 // n, 9)::INT AS seg FROM b),
ord AS (SELECT *, row_number() OVER (ORDER BY wr, o_totalprice DESC, o_orderkey) - 1 AS ord FROM w) """


def _orders(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    return S.within_group_rank(o, "o_custkey", "o_totalprice", "o_orderkey", "wr")


def _ordered(spark, d):
    """Orders with segment, rank inside the customer's group and global order."""
    o = O.numbered_in(_orders(spark, d), [], [F.col("o_orderdate"), F.col("o_orderkey")], "seq", "n")
    o = o.withColumn("seg", R.segment(F.col("seq"), F.col("n"), 10))
    return S.champions_first(o, "wr", "o_totalprice", "o_orderkey", "ord")


@query("entry_top20", _ORD + """, g AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY ord) AS g FROM ord)
SELECT o_orderkey, o_custkey, o_totalprice, ord FROM g WHERE g <= 2 ORDER BY ord LIMIT 20""")
def entry_top20(spark, d):
    """Rows before a kept one in the order are kept too, so places among the twenty are places among all."""
    order = [F.col("wr"), F.desc("o_totalprice"), F.col("o_orderkey")]
    top = S.top_with_cap(_orders(spark, d), "o_custkey", order, 20, 2)
    return top.select("o_orderkey", "o_custkey", "o_totalprice", (F.row_number().over(Window.orderBy(*order)) - 1).alias("ord"))


# ---- predicates ----
@query("f1_scope", "SELECT doc_id, lang IS NOT DISTINCT FROM 'fr' AS in_fr, true AS in_all FROM documents")
def f1(spark, d):
    scope = lambda s: F.lit(s == "all") | F.col("lang").eqNullSafe(s)
    return table(spark, d, "documents").select("doc_id", scope("fr").alias("in_fr"), scope("all").alias("in_all"))


@query("f2_keep", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def f2(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")


@query("f3_groupable", _PX + "SELECT vec_id FROM px WHERE list_max(p) - list_min(p) >= 12")
def f3(spark, d):
    return _px(spark, d).where(F.array_max("p") - F.array_min("p") >= 12).select("vec_id")


@query("f4_confident", "SELECT l_orderkey, list(l_extendedprice ORDER BY l_extendedprice DESC) AS areas FROM lineitem WHERE l_discount >= 0.055 GROUP BY l_orderkey")
def f4(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_extendedprice").alias("a"), F.col("l_discount").alias("c"))).alias("r"))
    kept = F.filter("r", lambda x: x["c"] >= 0.055)
    return g.select("l_orderkey", F.sort_array(F.transform(kept, lambda x: x["a"]), asc=False).alias("areas")).where(F.size("areas") > 0)


@query("f5_multi_groups", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 2")
def f5(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 2")


@query("f6_decisive", "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE (a.label = 0) <> (b.label = 0)")
def f6(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", (F.col("label") == 0).alias("g"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("g").alias("h"))
    return e.join(nxt, "vec_id").where("g <> h").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"))


_COS = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id) """


@query("f7_calibration_candidates", _COS + """SELECT v.vec_id FROM v WHERE label <> 0 AND label <> 9 AND NOT EXISTS (SELECT 1 FROM c JOIN v g ON g.label = 0 AND ((c.i = g.vec_id AND c.j = v.vec_id) OR (c.j = g.vec_id AND c.i = v.vec_id)) WHERE c.s > 0.2)""")
def f7(spark, d):
    e = table(spark, d, "embeddings")
    free = e.where("label NOT IN (0, 9)").select("vec_id", "embedding")
    near = M.near_any(free, e.where("label = 0"), "vec_id", "embedding", 0.2)
    return free.select("vec_id").join(near, "vec_id", "left_anti")


@query("f8_answered", "SELECT event_type, count(*) FILTER (value > 100) AS sent, count(*) FILTER (value <= 100) AS skipped FROM events GROUP BY event_type")
def f8(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 100).alias("sent"), F.count_if(F.col("value") <= 100).alias("skipped"))


@query("f9_candidate_list", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' AND p_size >= 10")
def f9(spark, d):
    return table(spark, d, "part").where("p_brand = 'Brand#11'").where("p_size >= 10").select("p_partkey")


# ---- joins ----
@query("j1_merge", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j1(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality")
    return table(spark, d, "documents").select("doc_id", "lang").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), "lang")


@query("j2_resolve_facts", "SELECT d.doc_id, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def j2(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id")


@query("j3_known_only", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j3(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")


@query("j4_eligible", "SELECT o_orderkey FROM orders WHERE o_orderpriority IS DISTINCT FROM '5-LOW' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def j4(spark, d):
    bad = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").where(~F.col("o_orderpriority").eqNullSafe("5-LOW")).join(bad, "o_custkey", "left_anti").select("o_orderkey")


@query("j5_no_leak", "SELECT doc_id FROM labels WHERE doc_id % 5 <> 0")
def j5(spark, d):
    labels = table(spark, d, "labels").select("doc_id")
    return labels.join(labels.where("doc_id % 5 = 0"), "doc_id", "left_anti")


@query("j6_replay_lookup", """WITH v AS (SELECT n_nationkey AS a, n_nationkey + 1 AS b, CASE n_nationkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'tie' END AS w FROM nation)
SELECT x.n_nationkey AS b, CASE v.w WHEN 'a' THEN 'b' WHEN 'b' THEN 'a' ELSE v.w END AS winner FROM nation x LEFT JOIN v ON v.a = x.n_nationkey - 1 AND v.b = x.n_nationkey""")
def j6(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    v = n.select(F.col("k").alias("a"), (F.col("k") + 1).alias("b"), F.when(F.col("k") % 3 == 0, "a").when(F.col("k") % 3 == 1, "b").otherwise("tie").alias("winner"))
    turned = n.select(F.col("k").alias("a"), (F.col("k") - 1).alias("b"))
    return turned.join(C.both_ways(v), ["a", "b"], "left").select(F.col("a").alias("b"), "winner")


@query("j7_pair_similarity", _COS + "SELECT i, j, round(s, 6) AS s FROM c WHERE s >= 0.3")
def j7(spark, d):
    return M.near_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.3).select("i", "j", F.round("s", 6).alias("s"))


@query("j8_group_pairs", "SELECT a.o_orderkey AS gold, b.o_orderkey AS other FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'P'")
def j8(spark, d):
    o = table(spark, d, "orders")
    gold = o.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("gold"))
    return gold.join(o.where("o_orderstatus = 'P'").select("o_custkey", F.col("o_orderkey").alias("other")), "o_custkey").select("gold", "other")


@query("j9_scene_match", "SELECT a.event_id AS i, b.event_id AS j FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id < b.event_id WHERE abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 3600000000 AND a.event_type = b.event_type")
def j9(spark, d):
    """A range join as an equi-join on time bins: each row meets its own and the neighbouring bins."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    step = 3_600_000_000
    g = F.floor(F.col("t") / step)
    a = e.select(F.col("event_id").alias("i"), "user_id", "event_type", F.col("t").alias("ti"), g.alias("g"))
    b = e.select(F.col("event_id").alias("j"), "user_id", "event_type", F.col("t").alias("tj"), F.explode(F.array(g - 1, g, g + 1)).alias("g"))
    return a.join(b, ["user_id", "event_type", "g"]).where((F.col("i") < F.col("j")) & (F.abs(F.col("ti") - F.col("tj")) <= step)).select("i", "j")


@query("j10_cross_scene", _COS + "SELECT c.i, c.j FROM c JOIN v a ON a.vec_id = c.i JOIN v b ON b.vec_id = c.j WHERE a.label <> b.label AND c.i // 50 <> c.j // 50 AND c.s > 0.32")
def j10(spark, d):
    e = table(spark, d, "embeddings")
    return M.near_pairs(e.where("label IS NOT NULL"), "vec_id", "embedding", 0.32, ["label"], lambda i, j, a, b: (a[0] != b[0]) & (i // 50 != j // 50)).where("s > 0.32").select("i", "j")


@query("j11_arm_audit", """SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both, count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b
FROM (SELECT doc_id AS a FROM labels WHERE quality = 1) x FULL JOIN (SELECT doc_id AS b FROM labels WHERE toxic = 0) y ON a = b""")
def j11(spark, d):
    t = table(spark, d, "labels")
    x = t.where("quality = 1").select("doc_id", F.lit(1).alias("a")).join(t.where("toxic = 0").select("doc_id", F.lit(1).alias("b")), "doc_id", "full")
    return x.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


@query("j12_complete_shards", """WITH f AS (SELECT l_orderkey AS k, min(l_returnflag) AS lo, max(l_returnflag) AS hi FROM lineitem WHERE l_orderkey % 23 > 0 GROUP BY 1),
p AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN (SELECT lo FROM f WHERE k = o_orderkey) ELSE 'N' END AS truth FROM orders WHERE o_orderkey % 5 = 0)
SELECT o_custkey FROM p LEFT JOIN f ON k = o_orderkey GROUP BY 1 HAVING bool_and(coalesce(lo = truth AND hi = truth, false))""")
def j12(spark, d):
    """Customers all of whose planned orders were found with one and the right answer; half of the plan knows the answer, and some orders were lost."""
    found = table(spark, d, "lineitem").where("l_orderkey % 23 > 0").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("truth"))
    least = found.groupBy("o_orderkey").agg(F.min("truth").alias("least"))
    plan = table(spark, d, "orders").where("o_orderkey % 5 = 0").select("o_custkey", "o_orderkey").join(least, "o_orderkey", "left")
    plan = plan.withColumn("truth", F.when(F.col("o_orderkey") % 2 == 0, F.col("least")).otherwise("N"))
    return A.complete_shards(plan.select("o_custkey", "o_orderkey", "truth"), found, "o_custkey", ["o_orderkey"], "truth")


@query("j13_unordered_pairs", "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem")
def j13(spark, d):
    return table(spark, d, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).distinct()


@query("j14_nearest", """WITH p AS (SELECT c_custkey AS i, c_acctbal AS x, (c_custkey * 7919 % 10007)::DOUBLE AS y FROM customer), t AS (SELECT p_partkey AS k, (p_partkey * 331 % 9001)::DOUBLE AS x, p_retailprice * 4 AS y FROM part),
d AS (SELECT p.i, t.k, (t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y) AS d FROM p, t)
SELECT i AS c_custkey, arg_min(k, (d, k)) AS p_partkey, round(min(d), 6) AS distance2 FROM d GROUP BY i""")
def j14(spark, d):
    """Customers and parts as points of a plane."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 7919 % 10007).cast("double").alias("y"))
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 331 % 9001).cast("double").alias("x"), (F.col("p_retailprice") * 4).alias("y"))
    return N.nearest_points(c, "c_custkey", p, "p_partkey").withColumn("distance2", F.round("distance2", 6))


@query("j15_unknown_ids", "SELECT l_partkey % 250 AS id, bool_or(s_suppkey IS NULL) AS unknown FROM lineitem LEFT JOIN supplier ON s_suppkey = l_partkey % 250 GROUP BY 1")
def j15(spark, d):
    ids = table(spark, d, "lineitem").select((F.col("l_partkey") % 250).alias("id")).distinct()
    known = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(True).alias("k"))
    return ids.join(known, "id", "left").select("id", F.col("k").isNull().alias("unknown"))


# ---- windows ----
@query("w1_champions_first", _ORD + "SELECT o_orderkey, ord FROM ord")
def w1(spark, d):
    return _ordered(spark, d).select("o_orderkey", "ord")


@query("w2_within_rank", _ORD + "SELECT o_orderkey, wr FROM w")
def w2(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return S.within_group_rank(o, "o_custkey", "o_totalprice", "o_orderkey", "wr").select("o_orderkey", "wr")


@query("w3_group_numbers", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place, count(*) OVER (PARTITION BY o_custkey) AS n, dense_rank() OVER (ORDER BY f) AS g FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f FROM orders)")
def w3(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("f"), F.count("*").alias("n"))
    first = O.numbered(first, [F.col("f")], "g", 1)
    return o.join(first, "o_custkey").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("place"), "n", "g")


@query("w4_recommendations", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate ASC NULLS LAST, o_orderkey) AS r FROM orders")
def w4(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), F.asc_nulls_last("o_orderdate"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("r"))


@query("w5_family_champions", """WITH c AS (SELECT p_partkey, p_type, coalesce(CASE WHEN p_size > 5 THEN p_brand END, 'own' || p_partkey) AS fam, p_retailprice FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY p_type, fam ORDER BY p_retailprice DESC, p_partkey) AS r FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS q FROM k WHERE r = 1) SELECT p_partkey, p_type, q FROM t WHERE q <= 5""")
def w5(spark, d):
    c = table(spark, d, "part").withColumn("fam", F.coalesce(F.when(F.col("p_size") > 5, F.col("p_brand")), F.concat(F.lit("own"), F.col("p_partkey").cast("string"))))
    best = F.row_number().over(Window.partitionBy("p_type", "fam").orderBy(F.desc("p_retailprice"), "p_partkey"))
    k = c.withColumn("r", best).where("r = 1")
    q = F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")).cast("long")
    return k.select("p_partkey", "p_type", q.alias("q")).where("q <= 5")


@query("w6_collapse", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) > 1 AS collapsed FROM orders")
def w6(spark, d):
    w = Window.partitionBy("o_custkey", "o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", (F.row_number().over(w) > 1).alias("collapsed"))


@query("w7_segments", _ORD + "SELECT o_orderkey, seg FROM w")
def w7(spark, d):
    return _ordered(spark, d).select("o_orderkey", "seg")


@query("w8_capped_top", """WITH o AS (SELECT p_partkey, p_brand, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS ord FROM part),
g AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY ord) AS g, count(*) OVER (PARTITION BY p_brand) AS n FROM o),
need AS (SELECT min(c) AS c FROM (SELECT c FROM range(1, 3000) t(c) JOIN (SELECT DISTINCT p_brand, n FROM g) ON true GROUP BY c HAVING sum(least(n, c)) >= least(100, (SELECT count(*) FROM o))))
SELECT p_partkey, p_brand, ord FROM g, need WHERE g.g <= need.c ORDER BY ord LIMIT 100""")
def w8(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    p = O.numbered(p, [F.desc("p_retailprice"), F.col("p_partkey")], "ord")
    return S.top_with_cap(p, "p_brand", [F.col("ord")], 100, 1).select("p_partkey", "p_brand", "ord")


@query("w9_boundary", "SELECT p_partkey, r FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r BETWEEN 18 AND 23")
def w9(spark, d):
    p = table(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(23)
    return p.select("p_partkey", F.row_number().over(Window.orderBy(F.desc("p_retailprice"), "p_partkey")).cast("long").alias("r")).where("r >= 18")


@query("w10_cut_line", "WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS r FROM orders) SELECT round(max(v) FILTER (r = 50) - max(v) FILTER (r = 51), 6) AS gap FROM r")
def w10(spark, d):
    return S.cut_line_gap(table(spark, d, "orders"), "o_totalprice", "o_orderkey", 50).select(F.round("gap", 6).alias("gap"))


_SIZES = "WITH s AS (SELECT o_custkey, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1 HAVING count(*) > 1) "


@query("w11_match_budget", _SIZES + "SELECT o_custkey, matches, spent::BIGINT AS spent FROM (SELECT *, least(n, 8) - 1 AS matches, sum(least(n, 8) - 1) OVER (ORDER BY n DESC, f) AS spent FROM s) WHERE spent <= 60")
def w11(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("f")).where("n > 1")
    return C.match_budget(s, "o_custkey", "n", "f", 60).select("o_custkey", "matches", "spent")


@query("w12_boundary_pairs", _ORD + """, m AS (SELECT *, ord < 200 AS sel FROM ord)
SELECT * FROM (SELECT o_custkey, arg_max(o_orderkey, ord) FILTER (sel) AS weakest, arg_min(o_orderkey, ord) FILTER (NOT sel) AS strongest FROM m GROUP BY 1) WHERE weakest IS NOT NULL AND strongest IS NOT NULL ORDER BY o_custkey LIMIT 40""")
def w12(spark, d):
    m = _ordered(spark, d).withColumn("sel", F.col("ord") < 200)
    g = m.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.when(F.col("sel"), F.col("ord"))).alias("weakest"), F.min_by("o_orderkey", F.when(~F.col("sel"), F.col("ord"))).alias("strongest"), F.count_if("sel").alias("s"), F.count_if(~F.col("sel")).alias("u"))
    return g.where("s > 0 AND u > 0").orderBy("o_custkey").limit(40).select("o_custkey", "weakest", "strongest")


@query("w13_anchor_choice", """WITH x AS (SELECT o_custkey AS g, o_orderkey AS i, o_totalprice AS r, o_orderstatus = 'F' AND o_custkey % 3 > 0 AND o_orderkey % 3 <= o_custkey % 3 AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(o_totalprice, 0) DESC, o_orderkey) AS p FROM orders),
f AS (SELECT g, count(*) FILTER (c) AS n, min(p) FILTER (c) AS b FROM x GROUP BY g),
k AS (SELECT g, CASE WHEN n = 0 THEN 'reject' WHEN n = 1 THEN 'win' ELSE 'multi' END AS kind, CASE b WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS typical, coalesce(CASE WHEN g % 4 > 0 THEN length(c_mktsegment) + g % 9 END, 0) AS said FROM f JOIN customer ON c_custkey = g),
q AS (SELECT g, row_number() OVER (PARTITION BY kind ORDER BY typical DESC, said DESC, g) AS t, CASE kind WHEN 'win' THEN 0 WHEN 'reject' THEN 1 ELSE 2 END AS seat FROM k),
s AS (SELECT g, row_number() OVER (ORDER BY CASE WHEN t = 1 THEN seat ELSE 3 END, CASE WHEN t = 1 THEN '' ELSE md5('20260901|' || g) END, g) - 1 AS place FROM q)
SELECT k.g AS o_custkey, kind, typical, CASE WHEN place < 8 THEN place END AS place FROM k JOIN s USING (g)""")
def w13(spark, d):
    """Customers as groups of orders: those chosen by a rule, with reasons of some length for most of them; eight anchors."""
    o, k = table(spark, d, "orders"), F.col("o_custkey") % 3
    o = o.select("o_custkey", "o_orderkey", "o_totalprice", ((F.col("o_orderstatus") == "F") & (k > 0) & (F.col("o_orderkey") % 3 <= k)).alias("c"))
    why = F.when(F.col("c_custkey") % 4 > 0, F.concat("c_mktsegment", F.repeat(F.lit("."), (F.col("c_custkey") % 9).cast("int"))))
    return S.choose_anchors(o, "o_custkey", "o_orderkey", "o_totalprice", "c", table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), why.alias("reason")), 8)


@query("w14_chunks", "SELECT s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) // 20 AS part FROM supplier")
def w14(spark, d):
    s = O.numbered(table(spark, d, "supplier").select("s_suppkey"), [F.col("s_suppkey")], "at")
    return s.select("s_suppkey", F.floor(F.col("at") / 20).alias("part"))


@query("w15_best_upsert", "SELECT user_id, arg_max(event_id, (CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END, epoch_us(ts), event_id)) AS event_id FROM events GROUP BY user_id")
def w15(spark, d):
    tier = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "signup", 2).otherwise(1)
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct(tier, "ts", "event_id")).alias("event_id"))


@query("w16_first_switch", "SELECT user_id, min(r) FILTER (event_type = 'error') AS first_error FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) GROUP BY user_id")
def w16(spark, d):
    r = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, d, "events").withColumn("r", r).groupBy("user_id").agg(F.min(F.when(F.col("event_type") == "error", F.col("r"))).alias("first_error"))


@query("w17_pinned_first", _ORD + "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey % 97 <> 0, ord) - 1 AS place FROM ord")
def w17(spark, d):
    return O.numbered(_ordered(spark, d), [F.col("o_orderkey") % 97 != 0, F.col("ord")], "place").select("o_orderkey", "place")


# ---- set operations ----
@query("u1_union", "SELECT s_suppkey AS k FROM supplier WHERE s_acctbal > 5000 UNION SELECT s_suppkey FROM supplier WHERE s_nationkey < 5")
def u1(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_acctbal", "s_nationkey")
    return s.where("s_acctbal > 5000").select("k").unionByName(s.where("s_nationkey < 5").select("k")).distinct()


@query("u2_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def u2(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").select("doc_id"))


@query("u3_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def u3(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, d, "orders").where("o_totalprice > 200000").select("o_custkey").distinct())


@query("u4_list_equality", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) = list(o_orderkey ORDER BY o_totalprice) AS same FROM orders GROUP BY o_custkey")
def u4(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("a"), F.array_sort(F.collect_list(F.struct("o_totalprice", "o_orderkey"))).alias("b"))
    return g.select("o_custkey", (F.col("a") == F.transform("b", lambda x: x["o_orderkey"])).alias("same"))


@query("u5_distinct_lists", "SELECT count(DISTINCT l) AS n FROM (SELECT list(DISTINCT event_type ORDER BY event_type)::VARCHAR AS l FROM events GROUP BY user_id)")
def u5(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_set("event_type"))).alias("l"))
    return g.agg(F.count_distinct("l").alias("n"))


@query("u6_families", """WITH RECURSIVE k AS (
  SELECT o_orderkey AS i, 'a' || o_custkey || ':' || (epoch_us(o_orderdate) // 15768000000000) AS key FROM orders
  UNION ALL SELECT o_orderkey, 'b' || (epoch_us(o_orderdate) // 86400000000) || o_orderstatus || (o_custkey % 40) FROM orders),
e AS (SELECT DISTINCT x.i AS a, y.i AS b FROM k x JOIN k y ON x.key = y.key AND x.i <> y.i),
r AS (SELECT a AS i, a AS root FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.i = e.a WHERE r.root < e.b),
f AS (SELECT i, min(root) AS family FROM r GROUP BY i)
SELECT i AS o_orderkey, family, count(*) OVER (PARTITION BY family) AS size FROM f""")
def u6(spark, d):
    """Orders of one customer in half a year, or of one day, status and class of customers, are one family, and so on."""
    t = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    half, day = F.floor(t / 15_768_000_000_000), F.floor(t / 86_400_000_000)
    o = table(spark, d, "orders").select(
        "o_orderkey", F.concat_ws(":", "o_custkey", half).alias("own"), F.concat_ws(":", day, "o_orderstatus", F.col("o_custkey") % 40).alias("day")
    )
    return G.families(o, "o_orderkey", ["own", "day"])


@query("u7_conflicts", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1 HAVING count(*) > 1")
def u7(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 300000").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1")


# ---- similarity ----
@query("a1_threshold", _COS + "SELECT round(greatest(quantile_cont(s, 0.98), 0.2), 9) AS t FROM c")
def a1(spark, d):
    t = M.threshold(table(spark, d, "embeddings"), "vec_id", "embedding", 0.98, 0.2)
    return spark.range(1).select(F.round(F.lit(t), 9).alias("t"))


@query("a2_near_pairs", _COS + ", t AS (SELECT quantile_cont(s, 0.995) AS t FROM c) SELECT count(*) AS n FROM c, t WHERE s >= t - 1e-12")
def a2(spark, d):
    e = table(spark, d, "embeddings")
    t = M.threshold(e, "vec_id", "embedding", 0.995, -1.0)
    return M.near_pairs(e, "vec_id", "embedding", t - 1e-12).agg(F.count("*").alias("n"))


@query("a3_concentration", _COS + ", m AS (SELECT (SELECT quantile_cont(s + 0.5, 0.5) FROM c JOIN v a ON a.vec_id = i JOIN v b ON b.vec_id = j WHERE a.label = 0 AND b.label = 0) AS own, (SELECT quantile_cont(s + 0.5, 0.5) FROM c) AS pool) SELECT round(own / pool, 6) AS concentration FROM m")
def a3(spark, d):
    """Similarities are shifted by 0.5, as the test vectors have none on average."""
    e = table(spark, d, "embeddings").withColumn("own", F.col("label") == 0)
    return spark.range(1).select(F.round(F.lit(M.concentration(e, "vec_id", "embedding", "own", 0.5)), 6).alias("concentration"))


_LEAD = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
c AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j, list_dot_product(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.25),
nb AS MATERIALIZED (SELECT v.vec_id AS id, row_number() OVER (ORDER BY v.vec_id) AS r, coalesce(list(c.i) FILTER (c.i IS NOT NULL), []) AS ns FROM v LEFT JOIN c ON c.j = v.vec_id GROUP BY v.vec_id),
walk AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS lead UNION ALL
 SELECT nb.r, CASE WHEN len(list_intersect(walk.lead, nb.ns)) = 0 THEN list_append(walk.lead, nb.id) ELSE walk.lead END FROM walk JOIN nb ON nb.r = walk.r + 1),
l AS (SELECT unnest(lead) AS id FROM (SELECT lead FROM walk ORDER BY r DESC LIMIT 1)) """


@query("q1_leader_groups", _LEAD + "SELECT v.vec_id, CASE WHEN v.vec_id IN (SELECT id FROM l) THEN v.vec_id ELSE (SELECT arg_max(c.i, (c.s, -c.i)) FROM c WHERE c.j = v.vec_id AND c.i IN (SELECT id FROM l)) END AS leader FROM v")
def q1(spark, d):
    e = table(spark, d, "embeddings")
    return M.vector_groups(e, "vec_id", "embedding", 0.25)


_SCENE = "WITH RECURSIVE " + _PX.removeprefix("WITH ") + """, h AS (SELECT vec_id, list_transform(p, lambda x: (x >= floor(list_sum(p) / 64))::INT) AS b, vec_id * 45 AS t, floor(list_sum(p) / 64) AS l FROM px WHERE list_max(p) - list_min(p) >= 12),
d AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j, abs(a.t - b.t) AS dt, abs(a.l - b.l) AS dl, list_sum(list_transform(range(1, 65), lambda k: abs(a.b[k] - b.b[k])))::INT AS h FROM h a JOIN h b ON a.vec_id < b.vec_id),
c AS MATERIALIZED (SELECT i, j, h FROM d WHERE (h <= 18 AND dl <= 5) OR (dt <= 900 AND h <= 26 AND dl <= 8)),
nb AS MATERIALIZED (SELECT v.vec_id AS id, row_number() OVER (ORDER BY v.vec_id) AS r, coalesce(list(c.i) FILTER (c.i IS NOT NULL), []) AS ns FROM h v LEFT JOIN c ON c.j = v.vec_id GROUP BY v.vec_id),
walk AS (SELECT 0::BIGINT AS r, []::BIGINT[] AS lead UNION ALL
 SELECT nb.r, CASE WHEN len(list_intersect(walk.lead, nb.ns)) = 0 THEN list_append(walk.lead, nb.id) ELSE walk.lead END FROM walk JOIN nb ON nb.r = walk.r + 1),
l AS (SELECT unnest(lead) AS id FROM (SELECT lead FROM walk ORDER BY r DESC LIMIT 1)),
g AS (SELECT v.vec_id, CASE WHEN v.vec_id IN (SELECT id FROM l) THEN v.vec_id ELSE (SELECT arg_min(c.i, (c.h, c.i)) FROM c WHERE c.j = v.vec_id AND c.i IN (SELECT id FROM l)) END AS leader FROM h v),
n AS (SELECT *, count(*) OVER (PARTITION BY leader) AS n FROM g)
SELECT vec_id, dense_rank() OVER (ORDER BY leader) AS "group", row_number() OVER (PARTITION BY leader ORDER BY vec_id) AS position, n AS count FROM n WHERE n > 1"""


@query("q2_scene_groups", _SCENE)
def q2(spark, d):
    """Limits are wider than the defaults, as the test rasters are noise."""
    from ..functions.geometry import block_hash

    mean = F.floor(F.aggregate("p", F.lit(0), lambda s, v: s + v) / 64)
    h = _px(spark, d).select("vec_id", block_hash(F.col("p")).alias("bits"), mean.alias("light"), (F.array_max("p") - F.array_min("p")).alias("contrast"))
    ts = F.timestamp_seconds(F.col("vec_id") * 45)
    return M.scene_groups(M.stored(h), "vec_id", "bits", "light", "contrast", ts, strict=(18, 5), loose=(26, 8), seconds=900)


# ---- tournaments ----
_VERD = """v AS (SELECT a.o_orderkey AS a, b.o_orderkey AS b, CASE substr(md5(least(a.o_orderkey, b.o_orderkey)::VARCHAR || '|' || greatest(a.o_orderkey, b.o_orderkey)::VARCHAR), 1, 1)
 WHEN '0' THEN 'a' WHEN '1' THEN 'a' WHEN '2' THEN 'a' WHEN '3' THEN 'b' WHEN '4' THEN 'b' WHEN '5' THEN 'b' WHEN '6' THEN 'b' WHEN '7' THEN 'tie' WHEN '8' THEN 'tie' WHEN 'a' THEN 'inconsistent' ELSE 'neither' END AS w
 FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey) """


def _verdicts(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    p = o.withColumnRenamed("o_orderkey", "a").join(o.withColumnRenamed("o_orderkey", "b"), "o_custkey").where("a < b")
    h = F.substring(F.md5(F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string"))), 1, 1)
    w = F.when(h.isin("0", "1", "2"), "a").when(h.isin("3", "4", "5", "6"), "b").when(h.isin("7", "8"), "tie").when(h == "a", "inconsistent").otherwise("neither")
    return p.select("a", "b", w.alias("winner"))


_TOUR = "WITH RECURSIVE " + _VERD + """, s AS (SELECT o_custkey AS g, o_orderkey AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders),
t AS (SELECT g, x AS champ, 1::BIGINT AS n, m, [x, 0][2:1] AS ch, ['z'][2:1] AS said FROM s WHERE n = 1 AND m > 1
 UNION ALL SELECT t.g, CASE WHEN (CASE WHEN t.champ < s.x THEN v.w WHEN v.w = 'a' THEN 'b' WHEN v.w = 'b' THEN 'a' ELSE v.w END) = 'b' THEN s.x ELSE t.champ END, s.n, t.m, list_append(t.ch, s.x),
 list_append(t.said, CASE WHEN t.champ < s.x THEN v.w WHEN v.w = 'a' THEN 'b' WHEN v.w = 'b' THEN 'a' ELSE v.w END)
 FROM t JOIN s ON s.g = t.g AND s.n = t.n + 1 AND s.n <= 8 JOIN v ON v.a = least(t.champ, s.x) AND v.b = greatest(t.champ, s.x)),
e AS (SELECT * FROM t WHERE n = least(m, 8)),
r AS (SELECT *, len(list_filter(said, lambda q: q <> 'inconsistent')) AS k FROM e) """


@query("q3_tournament", _TOUR + "SELECT g AS o_custkey, champ, len(said)::BIGINT AS matches, array_to_string(said, ',') AS said FROM r")
def q3(spark, d):
    t = C.tournaments(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey", "o_totalprice", _verdicts(spark, d))
    last = F.element_at("matches", -1)
    champ = F.when(last["verdict"] == "b", last["challenger"]).otherwise(last["champ"])
    return t.select("o_custkey", champ.alias("champ"), F.size("matches").cast("long").alias("matches"), F.array_join(F.transform("matches", lambda m: m["verdict"]), ",").alias("said"))


@query("q4_rejected_groups", _TOUR + "SELECT g AS o_custkey FROM r WHERE k > 0 AND len(list_filter(said, lambda q: q NOT IN ('inconsistent', 'neither'))) = 0 AND 2 * k >= len(said)")
def q4(spark, d):
    t = C.tournaments(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey", "o_totalprice", _verdicts(spark, d))
    return t.where("rejected").select("o_custkey")


@query("q10_fold_directions", """WITH x AS (SELECT event_id // 2 AS k, event_id % 2 AS d, CASE event_type WHEN 'click' THEN '1' WHEN 'view' THEN '2' WHEN 'error' THEN 'tie' WHEN 'signup' THEN 'neither' ELSE '1' END AS p,
    CASE WHEN event_id // 2 % 3 > 0 THEN 'c' || (event_id % 4)::VARCHAR END AS f, CASE WHEN event_id // 2 % 3 > 0 THEN 'd' || (event_id % 4)::VARCHAR END AS s, CASE WHEN user_id % 5 < 2 THEN 'c' || (event_id % 4)::VARCHAR WHEN user_id % 5 < 4 THEN 'd' || (event_id % 4)::VARCHAR ELSE 'zz' END AS w
    FROM events WHERE event_id % 11 > 0),
y AS (SELECT k, d, CASE WHEN f IS NULL OR p NOT IN ('1', '2') THEN p WHEN w = f THEN '1' WHEN w = s THEN '2' ELSE 'bad' END AS q, p FROM x),
z AS (SELECT k, d, CASE WHEN q IN ('1', '2') THEN CASE WHEN (q = '1') = (d = 0) THEN 'a' ELSE 'b' END ELSE q END AS v, q <> p AND q <> 'bad' AS turned FROM y)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL OR b.k IS NULL THEN NULL WHEN a.v = b.v AND a.v <> 'bad' THEN a.v ELSE 'inconsistent' END AS verdict,
       CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN a.v <> 'bad' AND b.v <> 'bad' AND (a.turned OR b.turned) END AS contradiction, CASE WHEN a.k IS NULL THEN 'AB' WHEN b.k IS NULL THEN 'BA' END AS missing
FROM (SELECT * FROM z WHERE d = 0) a FULL JOIN (SELECT * FROM z WHERE d = 1) b ON a.k = b.k""")
def q10(spark, d):
    """Two events are the two directions of a pair; two thirds of the pairs show codes, some of which are made up; some calls are lost."""
    kind, pair, e = F.col("event_type"), F.floor(F.col("event_id") / 2), table(spark, d, "events").where("event_id % 11 > 0")
    pick = F.when(kind == "click", "1").when(kind == "view", "2").when(kind == "error", "tie").when(kind == "signup", "neither").otherwise("1")
    code = lambda c: F.concat(F.lit(c), (F.col("event_id") % 4).cast("string"))
    read = F.when(F.col("user_id") % 5 < 2, code("c")).when(F.col("user_id") % 5 < 4, code("d")).otherwise("zz")
    calls = e.select(pair.alias("k"), F.when(F.col("event_id") % 2 == 0, "AB").otherwise("BA").alias("dir"), pick.alias("pick"), F.when(pair % 3 > 0, code("c")).alias("first_code"), F.when(pair % 3 > 0, code("d")).alias("second_code"), read.alias("winner_code"))
    return C.fold_directions(calls, ["k"])


@query("a41_wasted", "WITH RECURSIVE " + _VERD + """, u AS (SELECT * FROM v WHERE (a + b) % 5 > 0),
s AS (SELECT o_custkey AS g, o_orderkey AS x, o_totalprice AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders),
t AS (SELECT g, x AS champ, p, 1::BIGINT AS n, m, 0::BIGINT AS opp, 0::BIGINT AS was, '' AS said, false AS rec FROM s WHERE n = 1 AND m > 1
 UNION ALL SELECT t.g, CASE WHEN j.w = 'b' THEN s.x ELSE t.champ END, CASE WHEN j.w = 'b' THEN s.p ELSE t.p END, s.n, t.m, s.x, t.champ, j.w, j.r
 FROM t JOIN s ON s.g = t.g AND s.n = t.n + 1 AND s.n <= 8 LEFT JOIN u ON u.a = least(t.champ, s.x) AND u.b = greatest(t.champ, s.x),
 LATERAL (SELECT CASE WHEN u.w IS NULL THEN CASE WHEN t.p > s.p THEN 'a' WHEN s.p > t.p THEN 'b' ELSE 'tie' END WHEN t.champ < s.x THEN u.w WHEN u.w = 'a' THEN 'b' WHEN u.w = 'b' THEN 'a' ELSE u.w END AS w, u.w IS NOT NULL AS r) j),
pl AS (SELECT f.g, f.x AS a, s.x AS b, s.n - 2 AS pos FROM s f JOIN s ON f.g = s.g AND f.n = 1 AND s.n BETWEEN 2 AND 8),
pv AS (SELECT pl.*, CASE WHEN u.w IS NULL OR pl.a < pl.b THEN u.w WHEN u.w = 'a' THEN 'b' WHEN u.w = 'b' THEN 'a' ELSE u.w END AS w, EXISTS (SELECT 1 FROM t WHERE t.g = pl.g AND t.n > 1 AND least(t.was, t.opp) = least(pl.a, pl.b) AND greatest(t.was, t.opp) = greatest(pl.a, pl.b)) AS met
 FROM pl LEFT JOIN u ON u.a = least(pl.a, pl.b) AND u.b = greatest(pl.a, pl.b)),
c AS (SELECT g, count(*) AS planned, count(*) FILTER (met) AS consulted, count(*) FILTER (NOT met) AS never, min(pos) FILTER (w = 'b') AS first_switch FROM pv GROUP BY g),
k AS (SELECT g, count(*) FILTER (rec) AS answered, count(*) FILTER (NOT rec) AS by_score FROM t WHERE n > 1 GROUP BY g), e AS (SELECT t.g, t.champ <> s.x AS changed FROM t JOIN s ON s.g = t.g AND s.n = 1 WHERE t.n = least(t.m, 8))
SELECT c.g AS o_custkey, planned, consulted, never, answered, by_score, first_switch, changed FROM c JOIN k ON c.g = k.g JOIN e ON c.g = e.g""")
def a41(spark, d):
    """The plan lets the first seed meet every other one; a fifth of the verdicts never came back."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    verdicts = _verdicts(spark, d).where("(a + b) % 5 > 0")
    played = C.tournaments(o, "o_custkey", "o_orderkey", "o_totalprice", verdicts)
    plan = played.select("o_custkey", F.element_at("members", 1).alias("a"), F.posexplode(F.slice("members", 2, 7)).alias("pos", "b"))
    return C.replay_waste(plan, played, verdicts, "o_custkey")


@query("q11_judges", """SELECT a.s_suppkey, CASE WHEN a.s_acctbal > b.s_acctbal THEN 'a' WHEN b.s_acctbal > a.s_acctbal THEN 'b' ELSE 'tie' END AS local,
CASE WHEN a.s_nationkey < 5 AND b.s_nationkey < 5 THEN 'tie' WHEN a.s_nationkey < 5 THEN 'a' WHEN b.s_nationkey < 5 THEN 'b' ELSE 'neither' END AS oracle FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1""")
def q11(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    b = s.select((F.col("s_suppkey") - 1).alias("s_suppkey"), F.col("s_acctbal").alias("y"), F.col("s_nationkey").alias("m"))
    return s.join(b, "s_suppkey").select("s_suppkey", C.local_verdict(F.col("s_acctbal"), F.col("y")).alias("local"), C.oracle_verdict(F.col("s_nationkey") < 5, F.col("m") < 5).alias("oracle"))


@query("q12_eval_pairs", """SELECT a.o_orderkey AS gold, b.o_orderkey AS other, substr(sha256(a.o_orderkey::VARCHAR || chr(0) || b.o_orderkey::VARCHAR), 1, 1) < '8' AS gold_first, a.o_totalprice > b.o_totalprice AS local_correct
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderstatus = 'F' AND b.o_orderstatus = 'P'""")
def q12(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("gold"), F.col("o_totalprice").alias("x"))
    b = o.where("o_orderstatus = 'P'").select("o_custkey", F.col("o_orderkey").alias("other"), F.col("o_totalprice").alias("y"))
    first = T.first_shown(F.col("gold").cast("string"), F.col("other").cast("string"))
    return a.join(b, "o_custkey").select("gold", "other", first.alias("gold_first"), (F.col("x") > F.col("y")).alias("local_correct"))


@query("q13_tier_pairs", """WITH t AS (SELECT o_custkey AS q, o_orderkey AS x, CASE WHEN o_orderpriority < '2' THEN 1 WHEN o_orderpriority < '4' THEN 2 ELSE 3 END AS tier FROM orders)
SELECT a.q, a.x AS a, b.x AS b, CASE WHEN a.tier = 3 THEN 'neither' WHEN a.tier < b.tier THEN 'win' ELSE 'tie' END AS kind FROM t a JOIN t b ON a.q = b.q AND (a.tier < b.tier OR (a.tier = b.tier AND a.x < b.x)) WHERE NOT (a.tier < 3 AND b.tier = 3)""")
def q13(spark, d):
    tier = F.when(F.col("o_orderpriority") < "2", 1).when(F.col("o_orderpriority") < "4", 2).otherwise(3)
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("x"), tier.alias("t"))
    b = t.select("q", F.col("x").alias("b"), F.col("t").alias("u"))
    p = t.withColumnRenamed("x", "a").join(b, "q").where("(t < u OR (t = u AND a < b)) AND NOT (t < 3 AND u = 3)")
    return p.select("q", "a", "b", F.when(F.col("t") == 3, "neither").when(F.col("t") < F.col("u"), "win").otherwise("tie").alias("kind"))


# ---- selection under two caps ----
_WALK = "WITH RECURSIVE " + _ORD.removeprefix("WITH ") + """,
p1 AS (SELECT -1::BIGINT AS o, []::BIGINT[] AS ids, []::BIGINT[] AS fams, []::INT[] AS segs UNION ALL
 SELECT o.ord, CASE WHEN ok THEN list_append(ids, o.o_orderkey) ELSE ids END, CASE WHEN ok THEN list_append(fams, o.o_custkey) ELSE fams END, CASE WHEN ok THEN list_append(segs, o.seg) ELSE segs END
 FROM (SELECT p1.*, x.ord, x.o_orderkey, x.o_custkey, x.seg, len(list_filter(fams, lambda f: f = x.o_custkey)) < 2 AND len(list_filter(segs, lambda g: g = x.seg)) < 4 AS ok FROM p1 JOIN ord x ON x.ord = p1.o + 1 WHERE len(ids) < 40) o),
fin AS (SELECT ids FROM p1 ORDER BY o DESC LIMIT 1),
pk AS (SELECT unnest(ids) AS o_orderkey, generate_subscripts(ids, 1) - 1 AS pick FROM fin) """


def _picked(spark, d):
    o = _ordered(spark, d)
    return o, S.spread_selection(o, "o_orderkey", "o_custkey", "seg", "ord", 40, 2, 10)


@query("q5_spread_selection", _WALK + "SELECT o_orderkey, pick FROM pk")
def q5(spark, d):
    return _picked(spark, d)[1].select("o_orderkey", F.col("pick").cast("long").alias("pick"))


_DUEL = _WALK + """, sel AS (SELECT pk.pick, ord.* FROM pk JOIN ord USING (o_orderkey)), held AS (SELECT o_custkey, count(*) AS h FROM sel GROUP BY 1),
df AS (SELECT seg, arg_max(o_orderkey, pick) AS dk, arg_max(o_custkey, pick) AS dg, arg_max(o_totalprice, pick) AS ds FROM sel GROUP BY seg),
ch AS (SELECT o.seg, o.o_orderkey AS ck, o.o_custkey AS cg, o.o_totalprice AS cs, df.*, row_number() OVER (PARTITION BY o.seg ORDER BY o.ord) AS depth FROM ord o JOIN df ON df.seg = o.seg LEFT JOIN held ON held.o_custkey = o.o_custkey WHERE o.o_orderkey NOT IN (SELECT o_orderkey FROM sel) AND (o.o_custkey = df.dg OR coalesce(h, 0) + 1 <= 2)) """


@query("q6_marginal_contests", _DUEL + "SELECT seg AS segment, dk AS defender, ck AS challenger, round(ds - cs, 4) AS margin FROM ch WHERE depth = 1")
def q6(spark, d):
    o, picked = _picked(spark, d)
    return S.contests(o, picked, "o_orderkey", "o_custkey", "seg", "ord", "o_totalprice", 2).select("segment", "defender", "challenger", F.round("margin", 4).alias("margin"))


@query("q17_deep_contests", _DUEL + "SELECT seg AS segment, count(*) AS n, max(ck) AS top FROM ch WHERE depth <= 3 GROUP BY seg")
def q17(spark, d):
    o, picked = _picked(spark, d)
    c = S.contests(o, picked, "o_orderkey", "o_custkey", "seg", "ord", "o_totalprice", 2, deep=3)
    return c.groupBy("segment").agg(F.count("*").alias("n"), F.max("challenger").alias("top"))


def _applied(spark, d):
    o, picked = _picked(spark, d)
    duels = S.contests(o, picked, "o_orderkey", "o_custkey", "seg", "ord", "o_totalprice", 2)
    verdict = F.when(F.col("segment") % 4 == 3, None).when(F.col("segment") % 4 == 2, "neither").otherwise("b")
    return S.apply_verdicts(picked, duels.drop("depth").withColumn("verdict", verdict), "o_orderkey", "o_custkey", 2)


_APPLIED = _DUEL + """, du AS (SELECT *, row_number() OVER (ORDER BY round(ds - cs, 6), seg) AS rn, CASE WHEN seg % 4 = 3 THEN NULL WHEN seg % 4 = 2 THEN 'neither' ELSE 'b' END AS v FROM ch WHERE depth = 1),
s0 AS (SELECT list(o_orderkey ORDER BY pick) AS seats, list(o_custkey ORDER BY pick) AS fams FROM sel),
ap AS (SELECT 0::BIGINT AS rn, seats, fams, []::VARCHAR[] AS log FROM s0 UNION ALL
 SELECT x.rn, CASE WHEN what = 'swapped' THEN list_transform(seats, lambda q, i: CASE WHEN q = x.dk THEN x.ck ELSE q END) ELSE seats END,
  CASE WHEN what = 'swapped' THEN list_transform(fams, lambda q, i: CASE WHEN seats[i] = x.dk THEN x.cg ELSE q END) ELSE fams END, list_append(log, what)
 FROM (SELECT ap.seats, ap.fams, ap.log, du.*, CASE WHEN v IS NULL THEN 'missing' WHEN v <> 'b' THEN 'kept_' || v WHEN dg = cg OR len(list_filter(ap.fams, lambda q: q = du.cg)) + 1 <= 2 THEN 'swapped' ELSE 'refused_family_cap' END AS what
  FROM ap JOIN du ON du.rn = ap.rn + 1) x),
done AS (SELECT * FROM ap ORDER BY rn DESC LIMIT 1) """


@query("q7_apply_verdicts", _APPLIED + "SELECT seats AS final, len(log)::INT AS contests, " + ", ".join(f"len(list_filter(log, lambda q: q = '{k}'))::INT AS {k}" for k in ("swapped", "missing", "refused_family_cap", "kept_a", "kept_tie", "kept_neither", "kept_inconsistent")) + ", len(list_filter(log, lambda q: starts_with(q, 'kept_')))::INT AS kept FROM done")
def q7(spark, d):
    return _applied(spark, d)


@query("q8_invariants", _APPLIED + """, f AS (SELECT unnest(seats) AS o_orderkey FROM done), bad AS (SELECT o_orderkey FROM f UNION ALL SELECT max(o_orderkey) FROM f UNION ALL SELECT arg_min(o_orderkey, ord) FROM ord WHERE o_orderkey NOT IN (SELECT o_orderkey FROM f)),
br AS (SELECT ord.* FROM bad JOIN ord USING (o_orderkey))
SELECT 'length' AS problem, '' AS key, count(*) AS n FROM br HAVING count(*) <> 40 UNION ALL SELECT 'repeated', o_orderkey::VARCHAR, count(*) FROM br GROUP BY o_orderkey HAVING count(*) > 1
UNION ALL SELECT 'group cap', o_custkey::VARCHAR, count(*) FROM br GROUP BY o_custkey HAVING count(*) > 2
UNION ALL SELECT 'segment', seg::VARCHAR, sum(d)::BIGINT FROM (SELECT seg, 1 AS d FROM br UNION ALL SELECT seg, -1 FROM sel) GROUP BY seg HAVING sum(d) <> 0""")
def q8(spark, d):
    """The list after the duels with one item twice and one item more: what is broken must be found."""
    o, picked = _picked(spark, d)
    final = _applied(spark, d).select(F.explode("final").alias("o_orderkey"))
    twice = final.agg(F.max("o_orderkey").alias("o_orderkey"))
    more = o.join(final, "o_orderkey", "left_anti").orderBy("ord").limit(1).select("o_orderkey")
    broken = final.unionByName(twice).unionByName(more).join(o.select("o_orderkey", "o_custkey", "seg"), "o_orderkey")
    return S.broken_invariants(broken, picked, "o_orderkey", "o_custkey", "seg", 40, 2)


@query("s3_strided_sample", "WITH b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS pos, count(*) OVER () AS n FROM part) SELECT p_partkey FROM b WHERE pos IN (SELECT least(b2.n - 1, floor(i * b2.n / 37.0)::BIGINT) FROM range(37) t(i), (SELECT max(n) AS n FROM b) b2)")
def s3(spark, d):
    return S.strided_sample(table(spark, d, "part").select("p_partkey"), "p_partkey", 37)


@query("s17_runner_ups", "WITH s AS (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM s) GROUP BY o_custkey")
def s17(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return S.runner_ups(o, "o_custkey", "o_totalprice", "o_orderkey", o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50))
