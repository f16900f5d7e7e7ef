"""Ordered emission, live status and the sink of parts, with restarts."""

import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from winnowry.streaming import live, ordered
from winnowry.streaming.sink import PartSink


@pytest.fixture(scope="module")
def stateful(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ordered.STATE_STORE)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (folder / f".{name}").rename(folder / f"{name}.json")
    time.sleep(0.01)


SCHEMA = "run string, i long, a string, b string"


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))


def test_rows_come_in_order_across_a_restart(stateful, tmp_path):
    """Shuffled over micro-batches; the query is stopped half way and goes on from its checkpoint."""
    spark, r = stateful, random.Random(3)
    rows = [{"run": run, "i": i, "a": f"{run}{i}", "b": "x"} for run in "pq" for i in range(30)]
    r.shuffle(rows)
    rows.sort(key=lambda x: x["run"] == "p" and x["i"] == 0 and -1 or 0)  # one run can begin at once
    rows.insert(40, rows[5])
    wrong = next(x for x in rows if x["run"] == "q" and x["i"] == 7)
    plan = spark.createDataFrame([(x["run"], x["i"], x["a"], "y" if x is wrong else "x") for x in rows[:40] + rows[41:]], SCHEMA)
    out = []

    def go():
        stream = ordered.in_order(source(spark, tmp_path / "in"), "run", "i", plan, ["a", "b"])
        q = stream.writeStream.outputMode("append").foreachBatch(lambda d, n: out.extend((n, *x) for x in d.collect()))
        q.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    for k in range(4):
        put(tmp_path / "in", f"{k}", rows[k * 7 : k * 7 + 7])
    go()
    assert 0 < len(out) < 28
    put(tmp_path / "in", "4", rows[28:])
    go()
    for run in "pq":
        came = [(x[2], x[6]) for x in out if x[1] == run and x[6] != "repeat"]
        assert [i for i, _ in came] == list(range(30))
        assert [i for i, s in came if s == "mismatch"] == ([7] if run == "q" else [])
    assert [(x[1], x[2]) for x in out if x[6] == "repeat"] == [(rows[5]["run"], rows[5]["i"])]
    assert all(x[4] == f"{x[1]}{x[2]}" and x[5] == "x" for x in out)


def test_a_gap_is_told_after_the_wait(stateful, tmp_path):
    spark = stateful
    put(tmp_path / "in", "0", [{"run": "p", "i": i, "a": "a", "b": "b"} for i in (0, 1, 4, 5, 9)])
    stream = ordered.in_order(source(spark, tmp_path / "in"), "run", "i", wait=2)
    q = stream.writeStream.outputMode("append").format("memory").queryName("gaps").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()
    try:
        want = [(0, 0, "ok"), (1, 1, "ok"), (2, 3, "gap"), (4, 4, "ok"), (5, 5, "ok"), (6, 8, "gap"), (9, 9, "ok")]
        until = time.time() + 60
        while time.time() < until:
            got = sorted((x["i"], x["until"], x["status"]) for x in spark.table("gaps").collect())
            if got == want:
                break
            time.sleep(0.5)
        assert got == want
        put(tmp_path / "in", "1", [{"run": "p", "i": 3, "a": "late", "b": "b"}, {"run": "p", "i": 10, "a": "a", "b": "b"}])
        until = time.time() + 60
        while time.time() < until and spark.table("gaps").count() < 9:
            time.sleep(0.5)
        assert sorted((x["i"], x["status"]) for x in spark.table("gaps").where("a = 'late' OR i = 10").collect()) == [(3, "repeat"), (10, "ok")]
    finally:
        q.stop()


def test_report_of_a_log_equals_the_stream(stateful, tmp_path):
    spark, r = stateful, random.Random(9)
    rows = [{"run": run, "i": i, "a": run, "b": str(n)} for run in "pqr" for n, i in enumerate(r.choices(range(25), k=22))]
    log = spark.createDataFrame([(x["run"], x["i"], x["a"], x["b"]) for x in rows], SCHEMA)
    report = Counter((x["run"], x["i"], x["until"], x["status"]) for x in ordered.sequence_report(log, "run", "i", F.col("b").cast("int")).collect())
    want = Counter()
    for run in "pqr":
        seen = Counter(x["i"] for x in rows if x["run"] == run)
        want.update({(run, i, i, "repeat"): n - 1 for i, n in seen.items() if n > 1})
        last = -1
        for i in sorted(seen):
            want.update({(run, last + 1, i - 1, "gap"): 1} if i > last + 1 else {})
            last = i
    assert report == want
    put(tmp_path / "in", "0", rows)
    stream = ordered.in_order(source(spark, tmp_path / "in"), "run", "i", wait=0.2)
    q = stream.writeStream.outputMode("append").format("memory").queryName("log").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="300 milliseconds").start()
    try:
        until = time.time() + 90
        while time.time() < until:
            got = Counter((x["run"], x["i"], x["until"], x["status"]) for x in spark.table("log").where("status <> 'ok'").collect())
            if got == want:
                break
            time.sleep(0.5)
        assert got == want
    finally:
        q.stop()


def test_status_is_running_then_idle_then_done(stateful, tmp_path):
    spark = stateful
    plan = spark.createDataFrame([("p", 5), ("q", 1)], "run string, total long")
    put(tmp_path / "in", "0", [{"run": "p", "i": i} for i in range(3)] + [{"run": "q", "i": 0}, {"run": "n", "i": 0}])
    stream = live.watch_status(source(spark, tmp_path / "in"), plan, idle=3)
    seen = []
    q = stream.writeStream.outputMode("update").foreachBatch(lambda d, n: seen.extend(map(tuple, d.collect())))
    q = q.option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="500 milliseconds").start()

    def wait(*want):
        until = time.time() + 60
        while time.time() < until and not set(want) <= set(seen):
            time.sleep(0.3)
        assert set(want) <= set(seen), seen

    try:
        wait(("p", 3, 5, "running"), ("q", 1, 1, "done"), ("n", 1, 0, "running"))
        assert not any(x[3] == "idle" for x in seen)
        wait(("p", 3, 5, "idle"), ("n", 1, 0, "idle"))
        put(tmp_path / "in", "1", [{"run": "p", "i": 3}])
        wait(("p", 4, 5, "running"))
        put(tmp_path / "in", "2", [{"run": "p", "i": 4}])
        wait(("p", 5, 5, "done"))
        assert not any(x[0] == "q" and x[3] == "idle" for x in seen)
    finally:
        q.stop()


def test_status_by_the_clock(spark):
    calls = spark.createDataFrame([("p", 100), ("p", 200), ("q", 100), ("r", 100), ("x", 499)], "run string, t long").select("run", F.timestamp_seconds("t").alias("ts"))
    plan = spark.createDataFrame([("p", 3), ("q", 1), ("r", 5), ("w", 2)], "run string, total long")
    at = lambda s: {x["run"]: x["status"] for x in live.statuses(calls, plan, F.timestamp_seconds(F.lit(s))).collect()}
    assert at(400) == {"p": "running", "q": "done", "r": "running", "w": "waiting", "x": "running"}
    assert at(401)["r"] == "idle" and at(500)["p"] == "running" and at(501)["p"] == "idle" and at(9999)["q"] == "done"


def test_sink_killed_and_resumed_equals_one_run(spark, tmp_path):
    rows = [{"run": "p", "i": i, "a": f"a{i}", "b": None} for i in range(40)]
    for k in range(5):
        put(tmp_path / "in", f"{k}", rows[k * 8 : k * 8 + 8])
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    class Killed(PartSink):
        def write_batch(self, batch, number):
            if number == 2:
                super().write_batch(batch.limit(3), number)
                raise RuntimeError("killed")
            super().write_batch(batch, number)

    with pytest.raises(Exception, match="killed"):
        Killed(spark, out, ck).run(source(spark, tmp_path / "in"))
    with pytest.raises(FileExistsError, match="another run"):
        PartSink(spark, out, str(tmp_path / "ck2")).run(source(spark, tmp_path / "in"))
    calls = []
    stop_at_third = lambda: calls.append(1) or len(calls) == 3
    sink = PartSink(spark, out, ck)
    assert sink.run(source(spark, tmp_path / "in"), stop_at_third) is False
    assert sink.rows(SCHEMA).count() == 32 and not (tmp_path / "out").exists()
    assert sink.run(source(spark, tmp_path / "in")) is True
    got = sorted(x["i"] for x in spark.read.schema(SCHEMA).json(out).collect())
    assert got == list(range(40)) and not (tmp_path / "out.parts").exists()
    with pytest.raises(FileExistsError, match="exists already"):
        sink.run(source(spark, tmp_path / "in"))


def test_sink_finishes_after_a_crash_between_result_and_parts(spark, tmp_path):
    put(tmp_path / "in", "0", [{"run": "p", "i": 1, "a": "a", "b": "b"}])
    sink = PartSink(spark, str(tmp_path / "out"), str(tmp_path / "ck"))
    stream = source(spark, tmp_path / "in")
    sink.start(stream).awaitTermination()
    keep, sink._delete = sink._delete, lambda path: None
    sink.finish(stream.schema)
    assert (tmp_path / "out.parts").exists()
    sink._delete = keep
    sink.finish(stream.schema)
    assert not (tmp_path / "out.parts").exists() and spark.read.schema(SCHEMA).json(str(tmp_path / "out")).count() == 1
