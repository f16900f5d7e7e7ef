"""Queries of recorded runs: users are runs, their events the calls and their orders the matches; some break the rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import audits as A
from ..operators.stored import stored
from ..sources.runs import RUN, VERDICTS
from .registry import query, table

_MADE = """WITH e AS (SELECT user_id AS u, count(*) FILTER (event_id % 2 = 0 AND event_type <> 'signup') AS sent2, count(*) FILTER (event_id % 2 = 1 AND event_type <> 'signup') AS sent3,
    count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1),
o AS (SELECT o_custkey AS u, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders),
p AS (SELECT x.u, x.i // 2 AS seg, x.k AS a, y.k AS b FROM o x JOIN o y ON x.u = y.u AND y.i = x.i + 1 AND x.i % 2 = 0),
h AS (SELECT u, md5('[' || string_agg('["' || a || '","' || b || '"]', ',' ORDER BY seg) || ']') AS md5 FROM p GROUP BY u),
r AS (SELECT e.*, h.md5, h.md5 IS NOT NULL AS planned, u % 5 <> 0 AS vlm, u % 5 IN (2, 3) AS rubric, u % 5 IN (3, 4) AS anchors, CASE u % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B1' WHEN 2 THEN 'B2' WHEN 3 THEN 'B3' END AS g,
    NOT ((u % 5 = 0 AND u % 11 <> 0) OR u % 13 = 1) AS ins, CASE WHEN u % 23 = 0 THEN 'failed' WHEN u % 29 = 0 THEN 'off' ELSE 'ran' END AS s2, CASE WHEN u % 31 = 0 THEN 9 ELSE 10 END AS p2,
    CASE WHEN u % 5 = 0 THEN CASE WHEN u % 10 = 0 THEN 'ran' ELSE 'off' END WHEN u % 6 = 0 THEN 'failed' WHEN u % 6 = 1 THEN 'no_contests' ELSE 'ran' END AS s3, CASE WHEN u % 5 = 3 THEN 8 ELSE 0 END + CASE WHEN u % 41 = 0 THEN 1 ELSE 0 END AS p3
    FROM e LEFT JOIN h USING (u)),
q AS (SELECT *, g IS NOT NULL AND g <> 'A' AND s3 IN ('ran', 'no_contests') AS ran3, s3 = 'ran' AND u % 12 <> 5 AS judged FROM r),
c AS (
 SELECT u, g, 'known group' AS name, g IS NOT NULL AS ok FROM q
 UNION ALL SELECT u, g, 'no inputs without a third stage', NOT ins FROM q WHERE g = 'A'
 UNION ALL SELECT u, g, 'inputs recorded', ins FROM q WHERE ran3
 UNION ALL SELECT u, g, 'rubric read', u % 17 <> 0 FROM q WHERE ran3 AND ins AND rubric
 UNION ALL SELECT u, g, 'no rubric read', u % 19 <> 0 FROM q WHERE ran3 AND ins AND NOT rubric
 UNION ALL SELECT u, g, 'anchors of stage 3', p3 = CASE WHEN g = 'B3' THEN 8 ELSE 0 END FROM q WHERE ran3 AND ins
 UNION ALL SELECT u, g, 'anchors of stage 2', p2 = 10 FROM q WHERE s2 = 'ran'
 UNION ALL SELECT u, g, 'stage 2 ran', s2 = 'ran' FROM q WHERE g IS NOT NULL
 UNION ALL SELECT u, g, 'stage 3 ran', ran3 FROM q WHERE g <> 'A'
 UNION ALL SELECT u, g, 'stage 3 off', s3 = 'off' FROM q WHERE g = 'A'
 UNION ALL SELECT u, g, 'all matches judged', u % 43 <> 0 FROM q WHERE g <> 'A'
 UNION ALL SELECT u, g, 'all verdicts planned', u % 47 <> 0 FROM q WHERE g <> 'A'
 UNION ALL SELECT u, g, 'plan hash', u % 8 <> 3 FROM q WHERE planned
 UNION ALL SELECT u, g, 'calls of stage 2', u % 7 <> 0 FROM q
 UNION ALL SELECT u, g, 'calls of stage 3', true FROM q
 UNION ALL SELECT u, g, 'images of stage 2', u % 37 <> 0 FROM q
 UNION ALL SELECT u, g, 'images of stage 3', true FROM q
 UNION ALL SELECT u, g, 'hash of the verdicts', u % 14 <> 2 OR NOT planned FROM q WHERE judged
 UNION ALL SELECT u, g, 'plan of the verdicts', u % 16 <> 7 OR NOT planned FROM q WHERE judged),
v AS (SELECT u, g, string_agg(CASE WHEN NOT ok THEN name END, ', ' ORDER BY name) AS void FROM c GROUP BY ALL) """


def _records(spark, d):
    """(runs, calls, verdicts) as the readers of run folders give them."""
    u, run = F.col("u"), F.col("u").cast("string").alias("run")
    e = table(spark, d, "events").select(F.col("user_id").alias("u"), (F.col("event_id") % 2 + 2).cast("int").alias("stage"), (F.col("event_type") != "signup").alias("sent"), (F.col("event_type") != "error").alias("ok"))
    calls = e.select(run, "stage", "sent", "ok")
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("u")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))  # the orders of one user
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("k") / 2).cast("int") - 1), lambda i: F.struct(i.cast("long").alias("segment"), F.get("k", i * 2).cast("string").alias("a"), F.get("k", i * 2 + 1).cast("string").alias("b")))
    o = o.where(F.size("k") > 1).select("u", pairs.alias("plan"))
    users = e.groupBy("u").agg(F.count_if(F.col("sent") & (F.col("stage") == 2)).alias("sent2"), F.count_if(F.col("sent") & (F.col("stage") == 3)).alias("sent3"))
    r = users.join(o, "u", "left")
    lit, null = F.lit, lambda kind="string": F.lit(None).cast(kind)
    when = lambda m, k, x, y: F.when(u % m == k, x).otherwise(y)
    rubric, anchors = (u % 5).isin(2, 3), (u % 5).isin(3, 4)
    config = F.struct((u % 5 != 0).alias("stage3Vlm"), F.when(rubric, "rubric.md").alias("stage3RubricFile"), F.when(anchors, "anchors.json").otherwise("").alias("stage3AnchorsFile"))
    inputs = F.struct(F.when(rubric, when(17, 0, lit("bad"), lit("r1"))).alias("rubric_md5"), F.when(rubric, 100).otherwise(when(19, 0, lit(5), lit(0))).cast("long").alias("rubric_chars"))
    none = ((u % 5 == 0) & (u % 11 != 0)) | (u % 13 == 1)
    s2 = F.when(u % 23 == 0, "failed").when(u % 29 == 0, "off").otherwise("ran")
    s3 = F.when(u % 10 == 0, "ran").when(u % 5 == 0, "off").when(u % 6 == 0, "failed").when(u % 6 == 1, "no_contests").otherwise("ran")
    p2, p3 = when(31, 0, lit(9), lit(10)), F.when(u % 5 == 3, 8).otherwise(0) + when(41, 0, lit(1), lit(0))
    zero = lit(0).cast("long")
    part = lambda s, sent, photos, jpegs: [s.alias("status"), lit("broken").alias("error"), sent.cast("long").alias("comparisons"), zero.alias("preflights"), photos.cast("long").alias("anchor_photos_sent"), jpegs.cast("long").alias("anchor_jpegs_sent")]
    right = F.md5(A.plan_json(F.transform("plan", lambda p: F.array(p["a"], p["b"]))).cast("binary"))
    note = F.struct(when(43, 0, lit(1), lit(0)).cast("long").alias("missing"), when(47, 0, lit(2), lit(0)).cast("long").alias("unused"))
    stage3 = F.struct(*part(s3, F.col("sent3"), p3, p3 * 2), F.when(F.col("plan").isNotNull(), when(8, 3, lit("x"), right)).alias("plan_md5"), F.col("plan").alias("plan"), note.alias("note"))
    final = F.transform("plan", lambda p: F.when(p["b"].cast("long") % 3 == 0, p["b"]).otherwise(p["a"]))
    runs = r.select(
        run, "u", config.alias("config"), F.when(~none, inputs).alias("stage3_inputs"), F.struct(*part(s2, F.col("sent2") + when(7, 0, lit(1), lit(0)), p2, p2 * 2 - when(37, 0, lit(1), lit(0)))).alias("stage2"),
        stage3.alias("stage3"), F.transform("plan", lambda p: p["a"]).alias("delivered_after_stage2"), final.alias("delivered_final"), null().alias("started_at"),
    )
    runs = stored(runs.select("run", "u", *[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(RUN)]))

    def verdict(p):
        k = p["a"].cast("long")
        w = F.element_at(F.array(*map(F.lit, ("a", "b", "tie", "neither", "inconsistent"))), (k % 5 + 1).cast("int"))
        flip = F.when(w == "a", "b").when(w == "b", "a").otherwise(w)
        turned = k % 2 == 1
        ok = (k % 4 > 0).alias("consistent")
        return F.struct(F.when(turned, p["b"]).otherwise(p["a"]).alias("a"), F.when(turned, p["a"]).otherwise(p["b"]).alias("b"), F.when(turned, flip).otherwise(w).alias("winner"), ok, F.lit(True).alias("code_read_ok"), F.lit(False).alias("contradiction"))

    said = F.transform(F.filter("stage3.plan", lambda p: p["a"].cast("long") % 7 > 0), verdict)
    some = F.col("stage3.plan").isNotNull()
    verdicts = runs.where((F.col("stage3.status") == "ran") & (u % 12 != 5)).select(
        "run", F.lit(3).alias("stage"), F.when((u % 14 != 2) | ~some, F.col("stage3.plan_md5")).alias("plan_md5"), F.when(u % 16 != 7, F.col("stage3.plan")).alias("plan"), said.alias("verdicts")
    )
    verdicts = verdicts.select("run", "stage", *[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(VERDICTS)])
    return runs.drop("u"), calls, verdicts


def _checks(spark, d):
    runs, calls, verdicts = _records(spark, d)
    return A.checks(runs, calls, verdicts, A.Expected("r1")), calls


@query("a31_valid_runs", _MADE + "SELECT g AS \"group\", void IS NULL AS valid, count(*) AS runs, sum(sent2 + sent3)::BIGINT AS sent, sum(failed)::BIGINT AS failed FROM v JOIN e USING (u) GROUP BY ALL")
def a31(spark, d):
    checked, calls = _checks(spark, d)
    return A.costs(A.void_reasons(checked), calls)


@query("a32_run_scores", _MADE + """, x AS (SELECT p.*, ga.o_orderpriority = '1-URGENT' AS ag, gb.o_orderpriority = '1-URGENT' AS bg, b % 3 = 0 AS swap,
  CASE WHEN judged AND a % 7 > 0 THEN (['a', 'b', 'tie', 'neither', 'inconsistent'])[a % 5 + 1] END AS w, coalesce(judged AND a % 7 > 0 AND a % 4 > 0, false) AS firm
  FROM p JOIN q USING (u) JOIN orders ga ON ga.o_orderkey = a JOIN orders gb ON gb.o_orderkey = b),
y AS (SELECT *, CASE WHEN bg AND NOT ag THEN 'b' WHEN ag AND NOT bg THEN 'a' END AS side FROM x),
z AS (SELECT u, count(*) AS contests, count(*) FILTER (swap) AS swaps, count(*) FILTER (firm) AS consistent, count(*) FILTER (side = 'b') AS up, count(*) FILTER (side = 'a') AS down, count(*) FILTER (side = w) AS "right",
  count(*) FILTER (side <> w AND w IN ('a', 'b')) AS wrong, count(*) FILTER (side IS NOT NULL AND w = 'neither') AS neither, count(*) FILTER (side IS NOT NULL AND w IN ('tie', 'inconsistent')) AS unstated,
  count(*) FILTER (side IS NOT NULL AND w IS NULL) AS unjudged, count(*) FILTER (ag) AS overlap2, count(*) FILTER (CASE WHEN swap THEN bg ELSE ag END) AS overlap3 FROM y GROUP BY u),
f AS (SELECT q.u::VARCHAR AS run, coalesce(overlap2, 0) AS overlap2, coalesce(overlap3, 0) AS overlap3, coalesce(contests, 0) AS contests, coalesce(swaps, 0) AS swaps, coalesce(consistent, 0) AS consistent, coalesce(up, 0) AS up, coalesce(down, 0) AS down,
  coalesce("right", 0) AS "right", coalesce(wrong, 0) AS wrong, coalesce(neither, 0) AS neither, coalesce(unstated, 0) AS unstated, coalesce(unjudged, 0) AS unjudged FROM q LEFT JOIN z USING (u))
SELECT *, overlap3 - overlap2 AS net, overlap2 - down AS reach_low, overlap2 + up AS reach_high FROM f""")
def a32(spark, d):
    runs, _, verdicts = _records(spark, d)
    gold = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").cast("string").alias("item"))
    return A.scores(runs, verdicts, gold)


@query("a39_record_consistency", _MADE + 'SELECT g AS "group", name AS "check", ok, count(*) AS n FROM c GROUP BY ALL')
def a39(spark, d):
    checked, _ = _checks(spark, d)
    return checked.groupBy("group", "check", "ok").agg(F.count("*").alias("n"))


@query("s14_void_runs", _MADE + "SELECT u::VARCHAR AS run, g AS \"group\", coalesce(void, '') AS void FROM v")
def s14(spark, d):
    checked, _ = _checks(spark, d)
    return A.void_reasons(checked).withColumn("void", F.array_join("void", ", "))
