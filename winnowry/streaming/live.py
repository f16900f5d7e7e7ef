"""Whether the runs behind growing logs are done, running or idle."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: seconds without a row after which a run is idle.
IDLE = 300
_OUT = "run string, done long, total long, status string"


def status(done: Column, total: Column, last: Column, now: Column, idle: float = IDLE) -> Column:
    """done with all planned rows, idle after more than ``idle`` seconds without one, running, or waiting for the first row."""
    quiet = F.unix_micros(now) - F.unix_micros(last) > int(idle * 1_000_000)
    return (
        F.when((total > 0) & (done >= total), "done").when(F.coalesce(done, F.lit(0)) == 0, "waiting").when(quiet, "idle").otherwise("running")
    )


def statuses(calls: DataFrame, plan: DataFrame, now: Column, idle: float = IDLE) -> DataFrame:
    """(run, done, total, last, status) of every planned or logged run from calls (run, ts) and plan (run, total); total is null without a plan."""
    seen = calls.groupBy("run").agg(F.count("*").alias("done"), F.max("ts").alias("last"))
    both = plan.join(seen, "run", "full").withColumn("done", F.coalesce("done", F.lit(0)))
    return both.select("run", "done", "total", "last", status(F.col("done"), F.coalesce("total", F.lit(0)), F.col("last"), now, idle).alias("status"))


class _Live(StatefulProcessor):
    def __init__(self, idle: float) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "done long, total long")

    def _row(self, key, name: str | None = None) -> pd.DataFrame:
        done, total = self.seen.get()
        name = "done" if total and done >= total else name or "running"
        return pd.DataFrame([(key[0], done, total, name)], columns=["run", "done", "total", "status"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, total = self.seen.get() if self.seen.exists() else (0, 0)
        for part in rows:
            done += len(part)
            total = max(total, int(part["total"].fillna(0).max()))
        self.seen.update((done, total))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not (total and done >= total):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))
        yield self._row(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._row(key, "idle")

    def close(self) -> None:
        pass


def watch_status(calls: DataFrame, plan: DataFrame, idle: float = IDLE) -> DataFrame:
    """A stream of (run, done, total, status): a row whenever calls (run, ...) come, and one when ``idle`` seconds have passed without any.

    plan (run, total) is a table.  The clock is the cluster's: a timer in the state of each run is set anew by every
    row.  Output mode is update; the newest row of a run is its status.
    """
    known = calls.where("run IS NOT NULL").select("run").join(plan.select("run", F.col("total").cast("long").alias("total")), "run", "left")
    return known.groupBy("run").transformWithStateInPandas(_Live(idle), _OUT, "Update", "ProcessingTime")
