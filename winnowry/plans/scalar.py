"""Queries of ranks, scores, rasters, rectangles and text columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import ranks as R
from ..functions import rules as K
from ..functions import text as T
from ..operators import ordering as O
from ..operators.tournament import plan_json
from .registry import query, table


@query("p1_distinct_rank", """SELECT o_orderkey, round((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) / greatest(count(*) OVER () - 1, 1), 9) AS r FROM orders""")
def p1(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return R.distinct_rank(o, "o_totalprice", "o_orderkey", "r").select("o_orderkey", F.round("r", 9).alias("r"))


@query("p2_mid_rank", """SELECT p_partkey, round((2 * (rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1) + count(*) OVER (PARTITION BY p_brand, p_size)) / 2.0 / count(*) OVER (PARTITION BY p_brand), 9) AS r FROM part""")
def p2(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_brand")
    return R.mid_rank(p, "p_size", "r", ["p_brand"]).select("p_partkey", F.round("r", 9).alias("r"))


@query("p3_z_score", """SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER w) / CASE WHEN stddev_pop(c_acctbal) OVER w > 1e-9 THEN stddev_pop(c_acctbal) OVER w ELSE 1 END, 6) AS z FROM customer WINDOW w AS (PARTITION BY c_mktsegment)""")
def p3(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return R.z_score(c, "c_acctbal", "z", ["c_mktsegment"]).select("c_custkey", F.round("z", 6).alias("z"))


@query("p4_sparse_rank", """WITH x AS (SELECT event_id, CASE WHEN event_type = 'click' THEN value END AS v FROM events)
SELECT event_id, round(CASE WHEN v IS NULL THEN 0.5 ELSE (row_number() OVER (PARTITION BY v IS NULL ORDER BY v, event_id) - 1) / greatest(count(*) OVER (PARTITION BY v IS NULL) - 1, 1) END, 9) AS r FROM x""")
def p4(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", F.col("value")).alias("v"))
    return R.sparse_rank(e, "v", "event_id", "r").select("event_id", F.round("r", 9).alias("r"))


@query("p5_stratified_rank", """WITH x AS (SELECT o_orderkey, o_orderpriority AS s, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS v FROM orders)
SELECT o_orderkey, round(CASE WHEN v IS NULL THEN -1 WHEN count(*) OVER (PARTITION BY v IS NULL, s) = 1 THEN 0.5
 ELSE (row_number() OVER (PARTITION BY v IS NULL, s ORDER BY v, o_orderkey) - 1) / greatest(count(*) OVER (PARTITION BY v IS NULL, s) - 1, 1) END, 9) AS r FROM x""")
def p5(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("s"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("v"))
    return R.stratified_rank(o, "v", "o_orderkey", "s", "r").select("o_orderkey", F.round("r", 9).alias("r"))


@query("p6_metric_routing", """SELECT CASE WHEN avg((quality = 1)::INT) < 0.6 THEN 'general' ELSE 'face' END AS strategy, round(avg((quality = 1)::INT), 6) AS coverage FROM labels""")
def p6(spark, d):
    c = table(spark, d, "labels").agg(F.avg((F.col("quality") == 1).cast("int")).alias("coverage"))
    return c.select(R.metric_route(F.col("coverage")).alias("strategy"), F.round("coverage", 6).alias("coverage"))


@query("p7_inverted_rank", """SELECT s_suppkey, round(1 - (row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1) / greatest(count(*) OVER () - 1, 1), 9) AS r FROM supplier""")
def p7(spark, d):
    r = R.distinct_rank(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey", "r")
    return r.select("s_suppkey", F.round(1 - F.col("r"), 9).alias("r"))


@query("p8_composite_score", """WITH x AS (SELECT p_partkey, p_retailprice AS v, CASE WHEN p_size > 25 THEN p_size END AS f FROM part),
r AS (SELECT *, (row_number() OVER (ORDER BY v, p_partkey) - 1) / greatest(count(*) OVER () - 1, 1) AS g, avg((f IS NOT NULL)::INT) OVER () AS cover,
 (row_number() OVER (PARTITION BY f IS NULL ORDER BY f, p_partkey) - 1) / greatest(count(*) OVER (PARTITION BY f IS NULL) - 1, 1) AS fr FROM x),
c AS (SELECT *, CASE WHEN f IS NULL THEN 0.5 ELSE fr END AS face FROM r)
SELECT p_partkey, 'general' AS strategy, 'general' AS used, round(g, 9) AS score FROM c UNION ALL SELECT p_partkey, 'face', 'face', round(face, 9) FROM c UNION ALL SELECT p_partkey, 'blend', 'blend', round(0.5 * g + 0.5 * face, 9) FROM c
UNION ALL SELECT p_partkey, 'vision_face', 'vision_face', round(CASE WHEN f IS NULL THEN -1 ELSE fr END, 9) FROM c
UNION ALL SELECT p_partkey, 'auto', CASE WHEN cover < 0.6 THEN 'general' ELSE 'face' END, round(CASE WHEN cover < 0.6 THEN g ELSE face END, 9) FROM c""")
def p8(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("v"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("f"))
    out = None
    for s in ("general", "face", "blend", "vision_face", "auto"):
        scored, used = R.composite_score(p, "v", "f", "p_partkey", "score", s, "f")
        one = scored.select("p_partkey", F.lit(s).alias("strategy"), F.lit(used).alias("used"), F.round("score", 9).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


@query("p9_fusion_weight", """SELECT o_custkey, count(*) AS n, round(0.2 + least(greatest((count(*) - 5) / 15.0, 0), 1) * 0.5, 9) AS w FROM orders GROUP BY o_custkey""")
def p9(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return g.select("o_custkey", "n", F.round(R.fusion_weight(F.col("n"), 5, 20, 0.2, 0.7), 9).alias("w"))


@query("p10_mode_ladder", """WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS n, max(o_totalprice) / avg(o_totalprice) / 2 AS c FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN n = 0 THEN 'cold' WHEN o_custkey % 7 = 0 THEN 'probe off' WHEN n < 5 THEN 'too few' WHEN c > 1.05 THEN 'too concentrated' ELSE 'fused' END AS mode FROM g""")
def p10(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"), (F.max("o_totalprice") / F.avg("o_totalprice") / 2).alias("c"))
    return g.select("o_custkey", R.mode(F.col("n"), F.col("c"), F.col("o_custkey") % 7 != 0).alias("mode"))


_PX = """WITH v AS (SELECT vec_id, embedding::FLOAT[]::DOUBLE[] AS e FROM embeddings),
px AS (SELECT vec_id, list_transform(e, lambda x: CASE WHEN list_max(e) > list_min(e) THEN floor((x - list_min(e)) / (list_max(e) - list_min(e)) * 255)::INT ELSE 0 END) AS p FROM v) """


def _px(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return e.select("vec_id", G.raster(F.col("e")).alias("p"))


@query("p11_block_hash", _PX + """SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN p[i] >= floor(list_sum(p) / 64) THEN 1 ELSE 0 END))::BIGINT AS ones,
 (list_min(p))::INT AS lo, (list_max(p))::INT AS hi FROM px""")
def p11(spark, d):
    return _px(spark, d).select("vec_id", F.bit_count(G.block_hash(F.col("p"))).cast("long").alias("ones"), F.array_min("p").alias("lo"), F.array_max("p").alias("hi"))


@query("p12_hamming", _PX + """, h AS (SELECT vec_id, list_transform(p, lambda x: (x >= floor(list_sum(p) / 64))::INT) AS b, floor(list_sum(p) / 64)::INT AS m FROM px)
SELECT a.vec_id AS i, b.vec_id AS j, list_sum(list_transform(range(1, 65), lambda k: abs(a.b[k] - b.b[k])))::INT AS bits FROM h a JOIN h b ON b.vec_id = a.vec_id + 1 WHERE abs(a.m - b.m) <= 10""")
def p12(spark, d):
    h = _px(spark, d).select("vec_id", G.block_hash(F.col("p")).alias("b"), F.floor(F.aggregate("p", F.lit(0), lambda s, v: s + v) / 64).cast("int").alias("m"))
    a = h.select(F.col("vec_id").alias("i"), F.col("b").alias("x"), F.col("m").alias("u"))
    b = h.select((F.col("vec_id") - 1).alias("i"), F.col("vec_id").alias("j"), F.col("b").alias("y"), F.col("m").alias("w"))
    near = G.near_duplicate(F.col("x"), F.col("y"), F.col("u"), F.col("w"), 64, 10)
    return a.join(b, "i").where(near).select("i", "j", G.hamming(F.col("x"), F.col("y")).alias("bits"))


@query("p13_sharpness", _PX + """, m AS (SELECT vec_id, p, list_transform(list_filter(range(10, 56), lambda i: i % 8 NOT IN (1, 0)), lambda i: abs(4 * p[i] - p[i - 1] - p[i + 1] - p[i - 8] - p[i + 8])) AS g FROM px)
SELECT vec_id, round(list_sum(list_reverse_sort(g)[1:8]) / 8.0 / greatest(8, list_max(p) - list_min(p)), 9) AS sharp FROM m""")
def p13(spark, d):
    return _px(spark, d).select("vec_id", F.round(G.sharpness(F.col("p")), 9).alias("sharp"))


@query("p14_exposure", _PX + """SELECT vec_id, round(len(list_filter(p, lambda x: x <= 8)) / 64.0, 9) AS dark, round(len(list_filter(p, lambda x: x >= 247)) / 64.0, 9) AS light,
 (CASE WHEN list_max(p) - list_min(p) < 28 THEN 1 ELSE 0 END + CASE WHEN len(list_filter(p, lambda x: x <= 8)) / 64.0 >= 0.35 THEN 1 ELSE 0 END + CASE WHEN len(list_filter(p, lambda x: x >= 247)) / 64.0 >= 0.35 THEN 1 ELSE 0 END) AS n_risks FROM px""")
def p14(spark, d):
    dark, light, risks = G.exposure(F.col("p"))
    return _px(spark, d).select("vec_id", F.round(dark, 9).alias("dark"), F.round(light, 9).alias("light"), F.size(risks).alias("n_risks"))


@query("p15_eye_openness", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT vec_id, round(((list_max([e[2], e[4], e[6], e[8]]) - list_min([e[2], e[4], e[6], e[8]])) / (list_max([e[1], e[3], e[5], e[7]]) - list_min([e[1], e[3], e[5], e[7]]))
 + (list_max([e[10], e[12], e[14], e[16]]) - list_min([e[10], e[12], e[14], e[16]])) / (list_max([e[9], e[11], e[13], e[15]]) - list_min([e[9], e[11], e[13], e[15]]))) / 2, 6) AS openness FROM v""")
def p15(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    point = lambda i: F.struct(F.col("e")[i].alias("x"), F.col("e")[i + 1].alias("y"))
    eyes = F.array(F.array(*[point(i) for i in (0, 2, 4, 6)]), F.array(*[point(i) for i in (8, 10, 12, 14)]))
    return e.select("vec_id", F.round(G.eye_openness(eyes), 6).alias("openness"))


@query("p16_eligibility", """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag <> 'R' THEN l_discount * 4 END AS o, CASE WHEN l_linestatus = 'F' THEN l_tax * 5 END AS p, CASE WHEN l_quantity > 2 THEN l_quantity * 9 END AS px FROM lineitem),
y AS (SELECT *, coalesce(px >= 160, false) AND o IS NOT NULL AS m, coalesce(p > radians(12.0), false) AS down FROM x)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, m AS eyes_measured, down AS head_down, m AND coalesce(o < 0.22, false) AND NOT down AS closed FROM y""")
def p16(spark, d):
    """Eyes are not measured on returned lines, and pitch is known of closed lines only."""
    l = table(spark, d, "lineitem")
    e = K.eligibility(F.when(F.col("l_returnflag") != "R", F.col("l_discount") * 4), F.when(F.col("l_linestatus") == "F", F.col("l_tax") * 5), F.when(F.col("l_quantity") > 2, F.col("l_quantity") * 9))
    return l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", e.alias("e")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "e.*")


_RECT = """WITH r AS (SELECT vec_id, [abs(e[1]), abs(e[2]), abs(e[3]) + 0.1, abs(e[4]) + 0.1] AS a, [abs(e[5]), abs(e[6]), abs(e[7]) + 0.1, abs(e[8]) + 0.1] AS b FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
o AS (SELECT *, greatest(least(a[1] + a[3], b[1] + b[3]) - greatest(a[1], b[1]), 0) * greatest(least(a[2] + a[4], b[2] + b[4]) - greatest(a[2], b[2]), 0) AS x FROM r) """


def _rects(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("e"))
    rect = lambda i: F.array(F.col("e")[i], F.col("e")[i + 1], F.col("e")[i + 2] + 0.1, F.col("e")[i + 3] + 0.1)
    return e.select("vec_id", rect(0).alias("a"), rect(4).alias("b"))


@query("p17_rectangles", _RECT + "SELECT vec_id, round(x, 9) AS inter, round(x / least(a[3] * a[4], b[3] * b[4]), 6) AS share, x / least(a[3] * a[4], b[3] * b[4]) >= 0.2 AS same FROM o")
def p17(spark, d):
    a, b = F.col("a"), F.col("b")
    return _rects(spark, d).select("vec_id", F.round(G.overlap(a, b), 9).alias("inter"), F.round(G.overlap_share(a, b), 6).alias("share"), (G.overlap_share(a, b) >= 0.2).alias("same"))


_SEEN = """WITH b AS (
  SELECT l_orderkey AS o, l_linenumber % 3 AS kind, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos,
         l_partkey % 60 / 100.0::DOUBLE AS x, l_suppkey % 50 / 100.0::DOUBLE AS y, (4 + l_partkey % 5 * 9) / 100.0::DOUBLE AS w, (5 + l_suppkey % 4 * 15) / 100.0::DOUBLE AS h,
         0.5::DOUBLE + l_discount * 2 AS conf, CASE WHEN l_returnflag <> 'N' THEN l_tax * 30 END AS yaw, CASE WHEN l_linestatus = 'F' THEN l_discount * 8 END AS q FROM lineitem),
r AS (SELECT *, greatest(w, 0) * greatest(h, 0) AS area FROM b),
m AS (SELECT o_orderkey AS o, CASE WHEN o_custkey % 7 > 0 THEN o_custkey % 50 / 100.0::DOUBLE END AS mx, o_custkey % 40 / 100.0::DOUBLE AS my, (o_custkey % 6 * 9) / 100.0::DOUBLE AS mw, (o_custkey % 5 * 14) / 100.0::DOUBLE AS mh, o_orderkey % 20 / 1000.0::DOUBLE AS cover, o_orderkey % 4 + 1 AS inst FROM orders WHERE o_orderkey IN (SELECT o FROM b)),
"""


def _seen(spark, d):
    """Orders as pictures: every third line is a human, a face or a salient box, and the order has a mask."""
    l, hundred = table(spark, d, "lineitem"), lambda c: c / F.lit(100.0)
    box = F.array(hundred(F.col("l_partkey") % 60), hundred(F.col("l_suppkey") % 50), hundred(F.col("l_partkey") % 5 * 9 + 4), hundred(F.col("l_suppkey") % 4 * 15 + 5))
    row = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_linenumber") % 3).alias("kind"), box.alias("box"), (F.col("l_discount") * 2 + 0.5).alias("confidence"),
        F.when(F.col("l_returnflag") != "N", F.col("l_tax") * 30).alias("yaw"), F.when(F.col("l_linestatus") == "F", F.col("l_discount") * 8).alias("quality"),
    )
    rows = l.groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(row)).alias("rows"))  # the lines of one order
    of = lambda k, use: F.transform(F.filter("rows", lambda r: r["kind"] == k), use)
    mask = F.array(hundred(F.col("o_custkey") % 50), hundred(F.col("o_custkey") % 40), hundred(F.col("o_custkey") % 6 * 9), hundred(F.col("o_custkey") % 5 * 14))
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("o"), F.when(F.col("o_custkey") % 7 > 0, mask).alias("mask"), (F.col("o_orderkey") % 20 / F.lit(1000.0)).alias("coverage"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("instances")
    )
    humans = of(0, lambda r: F.struct(r["box"].alias("box"), r["confidence"].alias("confidence"))).alias("humans")
    faces = of(1, lambda r: F.struct(r["box"].alias("box"), r["yaw"].alias("yaw"), r["quality"].alias("quality"))).alias("faces")
    return rows.select("o", humans, faces, of(2, lambda r: r["box"]).alias("salient")).join(orders, "o")


@query("p18_best_support", _SEEN + """h AS (SELECT * FROM r WHERE kind = 0 QUALIFY row_number() OVER (PARTITION BY o ORDER BY area DESC, pos) = 1),
c AS (SELECT s.o, s.pos, greatest(least(h.x + h.w, s.x + s.w) - greatest(h.x, s.x), 0) * greatest(least(h.y + h.h, s.y + s.h) - greatest(h.y, s.y), 0) AS i, h.w * h.h AS ha, s.w * s.h AS sa FROM h JOIN r s ON h.o = s.o AND s.kind = 2),
g AS (SELECT o, i / ha AS p, i / sa AS s FROM c WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY o ORDER BY (i / ha) * (i / sa) DESC, pos) = 1)
SELECT h.o, round(coalesce(p, 0), 9) AS person, round(coalesce(s, 0), 9) AS salient FROM h LEFT JOIN g ON h.o = g.o""")
def p18(spark, d):
    """The largest human of each order against all its salient boxes."""
    s = _seen(spark, d).where(F.size("humans") > 0).select("o", "salient", K.largest(F.col("humans"))["box"].alias("h"))
    s = s.select("o", K.saliency_support(F.col("h"), F.col("salient")).alias("s"))
    return s.select("o", F.round("s.person", 9).alias("person"), F.round("s.salient", 9).alias("salient"))


@query("p19_rule_classifier", _SEEN + """su AS (SELECT *, area / sum(area) OVER (PARTITION BY o) AS share, count(*) OVER (PARTITION BY o) AS n, row_number() OVER (PARTITION BY o ORDER BY area DESC, pos) AS k FROM r WHERE kind = 0 AND conf >= 0.55),
fa AS (SELECT *, area / sum(area) OVER (PARTITION BY o) AS share, row_number() OVER (PARTITION BY o ORDER BY area DESC, pos) AS k FROM r WHERE kind = 1),
f AS (SELECT *, EXISTS (SELECT 1 FROM su WHERE su.o = fa.o AND su.area >= 0.05 AND least(su.x - 0.03 + (su.w + 0.06), fa.x + fa.w) > greatest(su.x - 0.03, fa.x) AND least(su.y - 0.03 + (su.h + 0.06), fa.y + fa.h) > greatest(su.y - 0.03, fa.y)) AS held FROM fa WHERE k = 1),
cp AS (SELECT o, least(0.98, 0.72 + least(0.16, area * 2) + coalesce(q, 0) * 0.10) AS c FROM f WHERE area >= 0.008 AND abs(coalesce(yaw, 0)) <= 1.45 AND share >= 0.42 AND coalesce(q >= 0.25, true) AND (area >= 0.018 OR held)),
e AS (SELECT m.*, su.o IS NOT NULL AS real, coalesce(su.x, mx) AS x, CASE WHEN su.o IS NULL THEN my ELSE su.y END AS y, CASE WHEN su.o IS NULL THEN mw ELSE su.w END AS w, CASE WHEN su.o IS NULL THEN mh ELSE su.h END AS h,
        coalesce(su.share, 1) AS share, coalesce(su.n, 1) AS n FROM m LEFT JOIN su ON m.o = su.o AND su.k = 1 WHERE su.o IS NOT NULL OR (mx IS NOT NULL AND mw > 0 AND mh > 0)),
t AS (SELECT *, w * h AS area, cover >= 0.006 AND mx IS NOT NULL AND mw * mh > 0 AND greatest(least(x + w, mx + mw) - greatest(x, mx), 0) * greatest(least(y + h, my + mh) - greatest(y, my), 0) / CASE WHEN least(w * h, mw * mh) > 0 THEN least(w * h, mw * mh) END >= 0.20 AS masked FROM e),
dp AS (SELECT o, least(0.96, 0.68 + area) AS c FROM t WHERE real AND area >= 0.10 AND share >= 0.52 AND masked),
i AS (SELECT t.o, s.pos, greatest(least(t.x + t.w, s.x + s.w) - greatest(t.x, s.x), 0) * greatest(least(t.y + t.h, s.y + s.h) - greatest(t.y, s.y), 0) AS i, t.area AS ta, s.w * s.h AS sa FROM t JOIN r s ON t.o = s.o AND s.kind = 2),
g AS (SELECT o, i / ta AS p, i / sa AS s FROM i WHERE i > 0 QUALIFY row_number() OVER (PARTITION BY o ORDER BY (i / ta) * (i / sa) DESC, pos) = 1),
pl AS (SELECT t.o, least(0.90, 0.60 + cover + p * 0.20) AS c FROM t JOIN g ON t.o = g.o WHERE area >= 0.018 AND share >= 0.52 AND greatest(n, inst) <= 3 AND masked AND p >= 0.5 AND s >= 0.1
        AND (EXISTS (SELECT 1 FROM r WHERE r.o = t.o AND r.kind = 0) OR (inst BETWEEN 1 AND 3 AND h / w >= 1.35 AND x >= 0.04 AND x + w <= 0.96)) AND x + w / 2 BETWEEN 0.06 AND 0.94 AND y + h / 2 BETWEEN 0.05 AND 0.95),
z AS (SELECT m.o, EXISTS (SELECT 1 FROM su WHERE su.o = m.o) OR EXISTS (SELECT 1 FROM fa WHERE fa.o = m.o) OR cover >= 0.006 AS seen FROM m)
SELECT z.o, CASE WHEN cp.o IS NOT NULL OR dp.o IS NOT NULL OR pl.o IS NOT NULL THEN 'people' ELSE 'scenery' END AS category,
  CASE WHEN cp.o IS NOT NULL THEN 'clear_portrait' WHEN dp.o IS NOT NULL THEN 'dominant_person' WHEN pl.o IS NOT NULL THEN 'person_in_landscape' WHEN seen THEN 'incidental_people' ELSE 'no_person' END AS reason,
  round(coalesce(cp.c, dp.c, pl.c, CASE WHEN seen THEN 0.72 ELSE 0.92 END), 9) AS confidence
FROM z LEFT JOIN cp ON z.o = cp.o LEFT JOIN dp ON z.o = dp.o LEFT JOIN pl ON z.o = pl.o""")
def p19(spark, d):
    s = _seen(spark, d)
    c = s.select("o", K.classify(*[F.col(c) for c in ("humans", "faces", "salient", "mask", "coverage", "instances")]).alias("c"))
    return c.select("o", "c.category", "c.reason", F.round("c.confidence", 9).alias("confidence"))


@query("p20_mask_statistics", _PX + """, c AS (SELECT vec_id, unnest(p) AS v, generate_subscripts(p, 1) - 1 AS i FROM px)
SELECT vec_id, round(sum(v) / 255.0 / 64, 6) AS coverage, min(i % 8) FILTER (v >= 64) AS x0, max(i % 8) FILTER (v >= 64) AS x1, 7 - max(i // 8) FILTER (v >= 64) AS y0, 7 - min(i // 8) FILTER (v >= 64) AS y1 FROM c GROUP BY vec_id""")
def p20(spark, d):
    c = _px(spark, d).select("vec_id", F.posexplode("p").alias("i", "v"))
    on, x, y = F.col("v") >= 64, (F.col("i") % 8).cast("long"), F.floor(F.col("i") / 8)
    return c.groupBy("vec_id").agg(
        F.round(F.sum("v") / 255 / 64, 6).alias("coverage"), F.min(F.when(on, x)).alias("x0"), F.max(F.when(on, x)).alias("x1"),
        (7 - F.max(F.when(on, y))).alias("y0"), (7 - F.min(F.when(on, y))).alias("y1"),
    )


@query("p21_group_score", """WITH x AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 11 > 0 THEN p_retailprice - 900 END AS sharp, p_size * 5 AS range, p_partkey % 10 / 10.0::DOUBLE AS dark, p_partkey % 3 / 10.0::DOUBLE AS bright, p_size > 10 AS clean FROM part)
SELECT p_partkey, round(CASE WHEN sharp IS NULL THEN 0 ELSE CASE WHEN max(sharp) OVER w > 0 THEN least(sharp / max(sharp) OVER w, 1) * 0.40 ELSE 0 END + range / 255.0::DOUBLE * 0.25 + greatest(0, 1 - least(1, dark + bright)) * 0.25 + CASE WHEN clean THEN 0.10 ELSE 0 END END, 9) AS s FROM x WINDOW w AS (PARTITION BY p_brand)""")
def p21(spark, d):
    p = table(spark, d, "part").select(
        "p_partkey", "p_brand", F.when(F.col("p_partkey") % 11 > 0, F.col("p_retailprice") - 900).alias("sharp"), (F.col("p_size") * 5).alias("range"), (F.col("p_partkey") % 10 / F.lit(10.0)).alias("dark"),
        (F.col("p_partkey") % 3 / F.lit(10.0)).alias("bright"), F.when(F.col("p_size") > 10, F.array().cast("array<string>")).otherwise(F.array(F.lit("small"))).alias("risks"),
    )
    p = O.attach(p, p.groupBy("p_brand").agg(F.max("sharp").alias("top")), ["p_brand"])
    return p.select("p_partkey", F.round(K.technical_score(*[F.col(c) for c in ("sharp", "top", "range", "dark", "bright", "risks")]), 9).alias("s"))


@query("p22_offline_score", """WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_tax AS b, -l_discount AS c, l_returnflag AS g FROM lineitem),
r AS (SELECT *, (2 * (rank() OVER (PARTITION BY g ORDER BY a) - 1) + count(*) OVER (PARTITION BY g, a)) / 2.0 / count(*) OVER (PARTITION BY g) AS ra,
 (2 * (rank() OVER (PARTITION BY g ORDER BY b) - 1) + count(*) OVER (PARTITION BY g, b)) / 2.0 / count(*) OVER (PARTITION BY g) AS rb,
 (2 * (rank() OVER (PARTITION BY g ORDER BY c) - 1) + count(*) OVER (PARTITION BY g, c)) / 2.0 / count(*) OVER (PARTITION BY g) AS rc FROM x)
SELECT l_orderkey, l_linenumber, greatest(0, least(100, round(round(ra * 55 + rb * 25 + rc * 20, 6) - CASE WHEN a < 3 THEN 30 ELSE 0 END - CASE WHEN c < -0.09 THEN 20 ELSE 0 END - CASE WHEN b < 0.01 THEN 10 ELSE 0 END + CASE WHEN a > 45 THEN 5 ELSE 0 END)))::INT AS score FROM r""")
def p22(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), F.col("l_tax").alias("b"), (-F.col("l_discount")).alias("c"), F.col("l_returnflag").alias("g"))
    for k in "abc":
        x = R.mid_rank(x, k, f"r{k}", ["g"])
    return x.select("l_orderkey", "l_linenumber", R.offline_score(F.col("ra"), F.col("rb"), F.col("rc"), F.col("a") < 3, F.col("c") < -0.09, F.col("b") < 0.01, F.col("a") > 45).alias("score"))


@query("p23_weighted_total", "SELECT p_partkey, ((2 * (p_size * 3 + (p_partkey % 100) * 2 + 50 * 1) + 6) // 12)::BIGINT AS total FROM part")
def p23(spark, d):
    return table(spark, d, "part").select("p_partkey", R.weighted_total([F.col("p_size"), F.col("p_partkey") % 100, F.lit(50)], [3, 2, 1]).alias("total"))


@query("p24_clamp_score", "SELECT event_id, greatest(0, least(100, floor(value / 3 + 0.5)))::INT AS s FROM events")
def p24(spark, d):
    return table(spark, d, "events").select("event_id", R.clamp_score(F.col("value") / 3).alias("s"))


@query("p26_anonymous_ids", "SELECT c_custkey, 'p' || lpad((row_number() OVER (ORDER BY c_custkey))::VARCHAR, greatest(3, length((count(*) OVER ())::VARCHAR))::INT, '0') AS anon FROM customer")
def p26(spark, d):
    return T.anonymous_ids(table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query("p28_relative_time", "SELECT event_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER ()) / 1000000.0)::BIGINT AS t FROM events")
def p28(spark, d):
    e = table(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("u"))
    low = e.agg(F.min("u").alias("low"))
    return e.crossJoin(F.broadcast(low)).select("event_id", F.round((F.col("u") - F.col("low")) / 1e6).cast("long").alias("t"))


@query("p29_display_scale", "SELECT event_id, coalesce(round(greatest(least(value / 5, 100), 0))::INT, -1) AS shown FROM events")
def p29(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.round(F.greatest(F.least(F.col("value") / 5, F.lit(100)), F.lit(0))).cast("int"), F.lit(-1)).alias("shown"))


@query("p31_first_shown", "SELECT s_suppkey, substr(sha256(s_name || chr(0) || s_suppkey::VARCHAR), 1, 1) < '8' AS a_first FROM supplier")
def p31(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", T.first_shown(F.col("s_name"), F.col("s_suppkey").cast("string")).alias("a_first"))


@query("p32_box_iou", _RECT + "SELECT vec_id, round(x / (a[3] * a[4] + b[3] * b[4] - x), 6) AS iou FROM o")
def p32(spark, d):
    scaled = G.normal_box(F.transform("a", lambda v: v * 100))
    small = F.array_max("a") * 100 > 1
    return _rects(spark, d).select("vec_id", F.round(G.iou(F.when(small, scaled).otherwise(F.col("a")), F.col("b")), 6).alias("iou"))


@query("p33_quality_rules", """SELECT doc_id, (CASE WHEN n_chars <> length(text) THEN 1 ELSE 0 END + CASE WHEN length(text) < 96 THEN 1 ELSE 0 END + CASE WHEN text LIKE '%@%' THEN 1 ELSE 0 END) AS n_bad FROM documents""")
def p33(spark, d):
    rule = lambda name, bad: F.when(bad, F.struct(F.lit(name).alias("name"), F.lit("error").alias("severity")))
    rules = F.array(rule("length", F.col("n_chars") != F.char_length("text")), rule("short", F.char_length("text") < 96), rule("address", F.col("text").contains("@")))
    return table(spark, d, "documents").select("doc_id", F.size(F.filter(rules, lambda r: r.isNotNull())).alias("n_bad"))


@query("p34_head_hash", "SELECT page_id, md5(html) AS h FROM pages")
def p34(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(F.substring(F.encode("html", "utf-8"), 1, 1 << 20)).alias("h"))


@query("p35_plan_hash", """SELECT n_regionkey, md5('[' || string_agg('["' || n_nationkey || '","' || n_name || '"]', ',' ORDER BY n_nationkey) || ']') AS h FROM nation GROUP BY n_regionkey""")
def p35(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.col("n_name")).alias("p"))))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.md5(plan_json(F.transform(rows, lambda r: r["p"]))).alias("h"))


@query("p36_text_tags", r"""SELECT doc_id, regexp_matches(text, '\b(the|and)\b') AS has_word, len(regexp_extract_all(text, '\d+')) AS n_numbers, contains(lower(text), 'license') AS leak FROM documents""")
def p36(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike(r"\b(the|and)\b").alias("has_word"), F.regexp_count("text", F.lit(r"\d+")).cast("long").alias("n_numbers"), F.lower("text").contains("license").alias("leak"))


@query("p37_failure_tags", """WITH x AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'HTTP ' || (400 + event_id % 100) || ' upstream' WHEN 'view' THEN 'Contract broken: field' WHEN 'click' THEN 'connection was terminated early' END AS e FROM events)
SELECT event_id, CASE WHEN e IS NULL THEN NULL WHEN regexp_extract(e, 'HTTP (\\d{3})', 1) <> '' THEN 'HTTP ' || regexp_extract(e, 'HTTP (\\d{3})', 1) WHEN contains(lower(e), 'contract') THEN 'contract' ELSE substr(e, 1, 20) END AS tag FROM x""".replace("\\\\", "\\"))
def p37(spark, d):
    kind = F.col("event_type")
    e = F.when(kind == "error", F.concat(F.lit("HTTP "), (F.col("event_id") % 100 + 400).cast("string"), F.lit(" upstream"))).when(kind == "view", "Contract broken: field").when(kind == "click", "connection was terminated early")
    return table(spark, d, "events").select("event_id", T.failure_tag(e).alias("tag"))


@query("p38_local_day", "SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%m-%d') AS day FROM events")
def p38(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Shanghai"), "MM-dd").alias("day"))


@query("p39_placeholder_order", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderpriority = '5-LOW')::INT, -o_totalprice, o_orderkey) AS r FROM orders")
def p39(spark, d):
    w = Window.partitionBy("o_custkey").orderBy((F.col("o_orderpriority") == "5-LOW").cast("int"), -F.col("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("r"))


@query("p40_split_total", "SELECT p_partkey, greatest((p_size + 1) // 2, 0)::INT AS hi, greatest(p_size // 2, 0)::INT AS lo FROM part")
def p40(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey", "greatest(cast((p_size + 1) div 2 as int), 0) AS hi", "greatest(cast(p_size div 2 as int), 0) AS lo")


@query("p41_last_line", r"""SELECT doc_id, regexp_replace(trim(list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)[-1]), '[.!?]+$', '') AS line FROM documents""")
def p41(spark, d):
    return table(spark, d, "documents").select("doc_id", T.last_line(F.col("text")).alias("line"))


@query("p42_chosen_pair", """WITH g AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS p, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderstatus = 'F'), []) AS c FROM orders GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN len(c) > 0 AND len(p) > len(c) THEN c[1] END AS won, CASE WHEN len(c) > 0 AND len(p) > len(c) THEN list_filter(p, lambda x: NOT list_contains(c, x))[1] END AS lost FROM g""")
def p42(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.array_sort(F.collect_list("o_orderkey")).alias("p"), F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))).alias("c")
    )
    pair = T.chosen_pair(F.col("p"), F.col("c"))
    return o.select("o_custkey", pair[0].alias("won"), pair[1].alias("lost"))


@query("s9_capture_time", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate - INTERVAL 90 MINUTE ELSE o_orderdate END AS taken FROM orders""")
def s9(spark, d):
    o = table(spark, d, "orders").withColumn("x", F.date_format(F.col("o_orderdate"), "yyyy:MM:dd HH:mm:ss"))
    even = F.col("o_orderkey") % 2 == 0
    bad = F.lit("not a date")
    t = T.capture_time(F.when(even, F.col("x")).otherwise(bad), F.when(even, bad).otherwise(F.col("x")), F.lit(None).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "+01:30").otherwise("+99:00"), F.lit(None).cast("timestamp"))
    return o.select("o_orderkey", t.cast("timestamp_ntz").alias("taken"))


@query("s19_crop_rectangle", _RECT + "SELECT vec_id, greatest(0, floor((a[1] - a[3] * 0.25) * 1000))::BIGINT AS x0, least(1000, ceil((a[1] + a[3] * 1.25) * 1000))::BIGINT AS x1, greatest(0, floor((1 - (a[2] + a[4] * 1.25)) * 800))::BIGINT AS y0 FROM o")
def s19(spark, d):
    r = G.crop(F.col("a"), 0.25, F.lit(1000), F.lit(800))
    return _rects(spark, d).select("vec_id", r[0].alias("x0"), r[2].alias("x1"), r[1].alias("y0"))
