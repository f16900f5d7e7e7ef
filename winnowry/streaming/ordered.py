"""Rows of a stream in the order of their numbers, with what is missing, repeated or not as planned."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Stateful operators need this class as spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _against(rows: DataFrame, key: str, seq: str, plan: DataFrame | None, match: list[str]) -> DataFrame:
    """Adds ``fits``: whether the row is what the plan has under its number."""
    if plan is None:
        return rows.withColumn("fits", F.lit(True))
    want = plan.select(F.col(key).alias("_k"), F.col(seq).alias("_i"), F.struct(*match).alias("_want"))
    both = rows.join(want, (F.col(key) == F.col("_k")) & (F.col(seq) == F.col("_i")), "left")
    return both.withColumn("fits", F.col("_want").isNotNull() & F.struct(*match).eqNullSafe(F.col("_want"))).drop("_k", "_i", "_want")


class _InOrder(StatefulProcessor):
    """Keeps early rows by number until all before them have come; a timer tells that the wait was in vain."""

    def __init__(self, names: list[str], wait: float | None) -> None:
        self.names, self.wait = names, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "n long")
        self.early = handle.getMapState("early", "n long", "row string, fits boolean")

    def _release(self, key, n: int, out: list) -> None:
        while self.early.containsKey((n,)):
            row, fits = self.early.getValue((n,))
            self.early.removeKey((n,))
            out.append((key, n, n, row, "ok" if fits else "mismatch"))
            n += 1
        self.next.update((n,))

    def _wait(self, timers) -> None:
        if self.wait is None:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if any(True for _ in self.early.keys()):
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + int(self.wait * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.next.get()[0] if self.next.exists() else 0
        out: list = []
        for part in rows:
            for i, row, fits in zip(part["seq"], part["row"], part["fits"], strict=True):
                if i < n or self.early.containsKey((int(i),)):
                    out.append((key[0], int(i), int(i), row, "repeat"))
                else:
                    self.early.updateValue((int(i),), (row, bool(fits)))
            self._release(key[0], n, out)
            n = self.next.get()[0]
        self._wait(timerValues)
        yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, out = self.next.get()[0], []
        first = min((int(k[0]) for k in self.early.keys()), default=None)
        if first is not None:
            out.append((key[0], n, first - 1, None, "gap"))
            self._release(key[0], first, out)
        self._wait(timerValues)
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def in_order(
    rows: DataFrame, key: str, seq: str, plan: DataFrame | None = None, match: list[str] | None = None, wait: float | None = None
) -> DataFrame:
    """A stream of (key, seq, until, the other columns, status) in which each key's rows come by number, from 0 on.

    A row that comes early is kept in the state until those before it have come.  status is ok; mismatch if the columns
    ``match`` are not what ``plan`` (key, seq, match) has there; repeat for a number that was seen, at once; gap, with
    seq to until missing, if ``wait`` seconds bring none of them (a late one is a repeat then).  Without ``wait`` there are no gaps.
    Rows with a null key or number are left out.
    """
    others = [c for c in rows.columns if c not in (key, seq)]
    known = _against(rows.where(F.col(key).isNotNull() & F.col(seq).isNotNull()), key, seq, plan, match or [])
    packed = known.select(F.col(key), F.col(seq).cast("long").alias("seq"), F.to_json(F.struct(*others)).alias("row"), "fits")
    kind = rows.schema[key].dataType
    out = T.StructType([T.StructField("key", kind), *[T.StructField(n, t) for n, t in (("seq", T.LongType()), ("until", T.LongType()), ("row", T.StringType()), ("status", T.StringType()))]])
    done = packed.groupBy(key).transformWithStateInPandas(_InOrder(out.names, wait), out, "Append", "None" if wait is None else "ProcessingTime")
    payload = T.StructType([rows.schema[c] for c in others])
    back = done.withColumn("row", F.from_json("row", payload))
    return back.select(F.col("key").alias(key), F.col("seq").alias(seq), "until", *[F.col(f"row.{c}").alias(c) for c in others], "status")


def sequence_report(rows: DataFrame, key: str, seq: str, first: Column, plan: DataFrame | None = None, match: list[str] | None = None) -> DataFrame:
    """(key, seq, until, status): what the stream would report of a finished log, all but the rows that are in order.

    Of rows with one number the smallest by ``first`` counts, the others are repeats; numbers that never came before the last one are gaps.
    """
    known = _against(rows.where(F.col(key).isNotNull() & F.col(seq).isNotNull()), key, seq, plan, match or [])
    turn = Window.partitionBy(key, seq).orderBy(first)
    ranked = known.select(F.col(key), F.col(seq).cast("long").alias("seq"), "fits", F.row_number().over(turn).alias("turn"))
    wrong = ranked.where("turn > 1 OR NOT fits").select(key, "seq", F.col("seq").alias("until"), F.when(F.col("turn") > 1, "repeat").otherwise("mismatch").alias("status"))
    last = F.coalesce(F.lag("seq").over(Window.partitionBy(key).orderBy("seq")), F.lit(-1))
    gaps = ranked.where("turn = 1").select(key, (last + 1).alias("from"), (F.col("seq") - 1).alias("until")).where("from <= until")
    return wrong.unionByName(gaps.select(key, F.col("from").alias("seq"), "until", F.lit("gap").alias("status"))).withColumnRenamed("seq", seq)
