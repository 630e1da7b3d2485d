"""Stop rules on a stream: scans of configurations end at a streak of misses or at a cap, and go on where they stood.

The state of a key is its place in the scan, its streak, what it has accepted, and whether it has stopped; it lives in the
state store, so a query that is started again resumes every key, and micro-batches may be of any size. Rows of a key come
in order from batch to batch; within a batch they are sorted. A batch's rows of one key are in one task, which
maxFilesPerTrigger bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "next long, streak long, accepted long, stopped boolean"


def scanned(place: np.ndarray, hit: np.ndarray, amount: np.ndarray, state: tuple, streak: int, cap: int) -> tuple[int, int, np.ndarray, tuple]:
    """(first, end, streaks, state after): the rows of a sorted batch that are scanned, each one's streak, by the state before it.

    hit is 1, 0 or -1 (leaves the streak alone); amount is what a hit adds. A scan ends before the row at which the cap is
    reached, and behind the row that completes the streak.
    """
    next_, run, accepted, stopped = state
    first = int(np.searchsorted(place, next_))
    hit, amount = hit[first:], np.where(hit[first:] == 1, amount[first:], 0)
    if stopped or not len(hit):
        return first, first, np.empty(0, np.int64), state
    misses = run + np.cumsum(hit == 0)
    streaks = misses - np.maximum.accumulate(np.where(hit == 1, misses, 0))
    before = accepted + np.cumsum(amount) - amount
    capped, run_out = np.flatnonzero(before >= cap), np.flatnonzero(streaks >= streak)
    end = min(int(capped[0]) if len(capped) else len(hit), int(run_out[0]) + 1 if len(run_out) else len(hit))
    over = len(capped) > 0 or len(run_out) > 0
    last = (int(place[first + end - 1]) + 1, int(streaks[end - 1]), int(accepted + amount[:end].sum()), over) if end else (next_, run, accepted, over)
    return first, first + end, streaks[:end], last


class Stops(StatefulProcessor):
    """Rows (key, place, hit, amount, others) to those that are scanned, with their streak."""

    def __init__(self, order: str, columns: list[str], streak: int, cap: int):
        self.order, self.columns, self.streak, self.cap = order, columns, streak, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("scan", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get() if self.state.exists() else (np.iinfo(np.int64).min, 0, 0, False)
        if state[3]:
            return
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        first, end, streaks, after = scanned(batch[self.order].to_numpy(), batch["is_hit"].to_numpy(), batch["hit_amount"].to_numpy(), tuple(state), self.streak, self.cap)
        self.state.update(after)
        if end > first:
            yield batch.iloc[first:end].assign(streak=streaks)[[*self.columns, "streak"]]

    def close(self) -> None:
        pass


def stopped(stream: DataFrame, key: str, order: str, hit: Column, streak: int, cap: int, amount: Column | None = None) -> DataFrame:
    """The scanned rows of a stream with their streak, by key in the order of a column of integers."""
    rows = stream.withColumn("is_hit", F.coalesce(hit.cast("long"), F.lit(-1).cast("long"))).withColumn("hit_amount", F.coalesce((F.lit(1) if amount is None else amount).cast("long"), F.lit(0).cast("long")))
    schema = StructType([*stream.schema.fields]).add("streak", LongType())
    return rows.groupBy(key).transformWithStateInPandas(Stops(order, stream.columns, streak, cap), schema, "Append", "None")


def scan(spark: SparkSession, folder: str, schema: str, key: str, order: str, hit: Column, streak: int, cap: int, out: str, checkpoint: str, amount: Column | None = None, per_trigger: int = 1000) -> DataFrame:
    """Scan the files that arrived since the last call with the same checkpoint, append to out, and return all that is there."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)
        rows = stopped(stream, key, order, hit, streak, cap, amount)
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(rows.schema).parquet(out)


def fed(df: DataFrame, folder: str, key: str, order: str, cuts: list[int]) -> None:
    """Append df to a folder in turns, cut at some values of order; rows of a key are in one file each time."""
    low = None
    for high in [*cuts, None]:
        part = df if low is None else df.where(F.col(order) >= low)
        part = part if high is None else part.where(F.col(order) < high)
        part.repartition(key).write.mode("append").parquet(folder)
        low = high
