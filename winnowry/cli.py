"""spark-submit entry: scan, pick, cut, preview, pairs, eval, curve, export over Parquet tables of items."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .engine import Config, Curation, ReplayJudge
from .operators.stored import stored
from .operators.tournament import match_budget
from .sources.files import dataset_fingerprint, guard_sink, list_items, read_verdicts, write_new


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="winnowry")
    p.add_argument("verb", choices=["scan", "pick", "cut", "preview", "pairs", "eval", "curve", "export"])
    p.add_argument("source", help="a folder of files for scan, a Parquet table (item, vector, score) for the others")
    p.add_argument("--out")
    p.add_argument("--gold", help="Parquet table of gold items")
    p.add_argument("--verdicts", help="JSON lines (a, b, winner)")
    p.add_argument("--labels", help="Parquet table of labelled items")
    p.add_argument("--use-probe", action="store_true", help="let the labels change the order if no guard is against it")
    p.add_argument("--names", nargs="*", type=int, default=[], help="items to preview")
    p.add_argument("--exclude", nargs="*", default=[])
    p.add_argument("--target", type=int, default=20)
    p.add_argument("--floor", type=float, default=0.90)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.verb == "scan":
        items = list_items(spark, a.source, a.exclude)
        out = items.crossJoin(dataset_fingerprint(items))
    else:
        c = Curation(spark, spark.read.parquet(a.source), Config(target=a.target, floor=a.floor, use_probe=a.use_probe))
        if a.verb in ("eval", "curve") and not a.gold:
            p.error(f"{a.verb} needs --gold")
        judge, labels = ReplayJudge(read_verdicts(spark, a.verdicts)) if a.verdicts else None, spark.read.parquet(a.labels) if a.labels else None
        ranked = None if a.verb == "curve" else stored(c.rank(judge, labels))
        if a.verb == "curve":
            out = c.curve(spark.read.parquet(a.gold))
        elif a.verb == "pick":
            out = c.select(ranked)
        elif a.verb == "cut":
            out = c.explain(ranked, c.select(ranked))
        elif a.verb == "preview":
            out = c.preview(ranked, a.names)
        elif a.verb == "export":
            out = c.export(ranked, c.select(ranked))
        elif a.verb == "pairs":
            sizes = ranked.groupBy("family").agg({"item": "count"}).withColumnRenamed("count(item)", "n").where("n > 1")
            out = match_budget(sizes, "family", "n", "family", c.config.match_budget)
        else:
            out = c.evaluate(ranked, spark.read.parquet(a.gold), a.target, c.select(ranked))
    if a.out:
        write_new(out, guard_sink(a.out, [a.source]))
    else:
        out.show(100, truncate=False)


if __name__ == "__main__":
    main()
