"""Inspection feeds, deduplication, counters and the review state machine as streams."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from datetime import timedelta
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.decisions import Rules, decide
from ..operators.windows import first_by_key
from ..sources.sinks import append_audit, audit_rows

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def inspection_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 100, glob: str | None = None) -> DataFrame:
    """Parquet files of a growing directory, some per trigger."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    return (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append", once: bool = True, every: str = "10 seconds") -> StreamingQuery:
    """Start a stream into each(batch, id); the checkpoint lets it go on where it stopped."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def to_parquet(stream: DataFrame, checkpoint: str, path: str) -> StreamingQuery:
    """All available rows appended to Parquet, each exactly once."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)


def dedup_stream(df: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark; rows with a null key all pass. ts must be a zoned timestamp."""
    late = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    own = F.when(F.col(key).isNull(), F.uuid()).otherwise(F.col(key).cast("string"))
    return late.withColumn("_key", own).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def dedup_against(history: str, key: str, order: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows of keys that the Parquet history lacks are appended, the first of each."""

    def each(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.schema(batch.schema).parquet(history)
            known.limit(0).count()
        except Exception as why:
            if "PATH_NOT_FOUND" not in str(why):
                raise
            known = None
        first_by_key(batch, key, order, known).write.mode("append").parquet(history)

    return each


def daily_counts(df: DataFrame, ts: str, status: str, delay: str) -> DataFrame:
    """day and status with n, given out when a day is past the watermark."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.groupBy(F.window(ts, "1 day").alias("w"), status).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), status, "n")


class ReviewState(StatefulProcessor):
    """First action of a review by (ts, action_id) is final; every other action conflicts. Order holds within a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.final = handle.getValueState("final", "action string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        actions = pd.concat(list(rows)).sort_values(["ts", "action_id"])
        open_ = not self.final.exists()
        out = actions[["action_id", "action"]].assign(review_id=key[0], accepted=False)
        if open_ and len(out):
            out.iloc[0, out.columns.get_loc("accepted")] = True
            self.final.update((out["action"].iloc[0],))
        yield out[["review_id", "action_id", "action", "accepted"]]

    def close(self) -> None:
        pass


def review_stream(actions: DataFrame) -> DataFrame:
    """review_id, action_id, action and accepted of a stream of actions (review_id, action_id, action, ts).

    Needs the RocksDB state store provider (ROCKSDB) in spark.sql.streaming.stateStore.providerClass.
    """
    schema = "review_id long, action_id long, action string, accepted boolean"
    return actions.groupBy("review_id").transformWithStateInPandas(ReviewState(), schema, "Append", "none")


#: Groups that reviews are dealt to: state, timers and calls to the state store are by group, not by review or action.
GROUPS = 256
#: Actions of a group that are dealt to slots at once.
DEALT = 200_000
#: Waiting actions of a group.
WAITING = pa.schema([("review_id", pa.int64()), ("us", pa.int64()), ("action_id", pa.int64()), ("action", pa.string())])
#: Rounds of a group that are not over.
OPENED = pa.schema([("review_id", pa.int64()), ("us", pa.int64())])


def _bytes(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(data)).read_all()


def settle(actions: pa.Table, opened: dict[int, int], keep: int) -> tuple[pa.Table, np.ndarray]:
    """The actions by review, time and action_id, and which of them are accepted; opened: the time of each review's accepted
    action, brought up to date."""
    actions = actions.sort_by([("review_id", "ascending"), ("us", "ascending"), ("action_id", "ascending")])
    review, us = actions["review_id"].to_numpy(), actions["us"].to_pylist()
    accepted = np.zeros(len(review), bool)
    begins = np.flatnonzero(np.append(True, review[1:] != review[:-1])) if len(review) else np.zeros(0, int)
    for key, at, end in zip(review[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(review)]):
        if key in opened:
            at = bisect_right(us, opened[key] + keep, at, end)
        while at < end:
            accepted[at], opened[key] = True, us[at]
            at = bisect_right(us, us[at] + keep, at + 1, end)
    return actions, accepted


class ReviewRounds(StatefulProcessor):
    """Actions of a group of reviews wait in the state until the watermark has passed them, and are then settled by review in
    the order (time, action_id).

    pending holds the waiting actions by slots of time as long as a round, with the time of the slot's timer: its earliest
    action; opened is the time of each review's accepted action while its round lasts, with the time when the last one is
    over. What is settled or over is removed, so reviews that are no longer used leave no state behind.
    """

    def __init__(self, keep: int) -> None:
        self.keep, self.width = keep, max(keep // 1000, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "slot long", "at long, actions binary")
        self.opened = handle.getValueState("opened", "at long, rounds binary")

    def wait(self, slot: int, at: int, timer: int | None, actions: pa.Table) -> None:
        """Keep a slot's actions; at: the earliest, timer: that which is set."""
        self.pending.updateValue((slot,), (at, _bytes(actions)))
        if timer != at:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = []
        for part in rows:
            held.append(pa.Table.from_pandas(part[WAITING.names], WAITING, preserve_index=False))
            if sum(map(len, held)) >= DEALT:
                self.deal(pa.concat_tables(held))
                held.clear()
        if held:
            self.deal(pa.concat_tables(held))
        yield from ()

    def deal(self, actions: pa.Table) -> None:
        at = -(-actions["us"].to_numpy() // 1000)
        slots = at // self.width
        for slot in np.unique(slots).tolist():
            here, timer = slots == slot, None
            some, first = actions.filter(pa.array(here)), int(at[here].min())
            if self.pending.containsKey((slot,)):
                timer, before = self.pending.getValue((slot,))
                some, first = pa.concat_tables([_table(before), some]), min(first, timer)
            self.wait(slot, first, timer, some)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        expired, passed = int(expiredTimerInfo.getExpiryTimeInMs()), int(timerValues.getCurrentWatermarkInMs())
        slot, over, rounds, reached = expired // self.width, None, {}, expired
        if self.opened.exists():
            over, data = self.opened.get()
            rounds = dict(zip(*(c.to_pylist() for c in _table(data).columns)))
        timer, data = self.pending.getValue((slot,)) if self.pending.containsKey((slot,)) else (None, None)
        if timer == expired:
            actions = _table(data)
            at = -(-actions["us"].to_numpy() // 1000)
            due = at <= passed
            if due.all():
                self.pending.removeKey((slot,))
            else:
                self.wait(slot, int(at[~due].min()), None, actions.filter(pa.array(~due)))
            actions, accepted = settle(actions.filter(pa.array(due)), rounds, self.keep)
            yield actions.select(["review_id", "action_id", "action"]).append_column("accepted", pa.array(accepted)).to_pandas()
            reached = min((slot + 1) * self.width, passed + 1)
        # what is not settled yet comes in this millisecond or later, though the watermark may be further on
        rounds = {k: us for k, us in rounds.items() if us + self.keep > (reached - 1) * 1000}
        end = -(-(max(rounds.values()) + self.keep) // 1000) + 1 if rounds else None
        if over is not None and over not in (expired, end):
            self.handle.deleteTimer(over)
        if rounds:
            self.opened.update((end, _bytes(pa.table([list(rounds), list(rounds.values())], schema=OPENED))))
            if end != over:
                self.handle.registerTimer(end)
        elif over is not None:
            self.opened.clear()

    def close(self) -> None:
        pass


def review_rounds(actions: DataFrame, delay: str, keep: timedelta, groups: int = GROUPS) -> DataFrame:
    """review_id, action_id, action and accepted of a stream of actions (review_id, action_id, action, ts).

    The first action of a review by (ts, action_id) is accepted and opens a round of length keep; the others of the round
    conflict; the first after it opens the next. An action is settled when the watermark, delay behind the newest ts, has
    passed it, so any cut of the feed into files whose rows are at most delay out of order gives the same rows. Spark leaves
    out rows that come later than that, and counts them in the query's progress; rows without a review or a ts are left out
    too. Reviews are dealt to `groups` by hash; a task holds the actions of one group within a time of `keep`. The number stays
    as it is for as long as a checkpoint is used. Needs the RocksDB state store provider (ROCKSDB).
    """
    schema = "review_id long, action_id long, action string, accepted boolean"
    timed = actions.where("review_id is not null and ts is not null").withWatermark("ts", delay).withColumns({"us": F.unix_micros("ts"), "group": F.pmod(F.xxhash64("review_id"), F.lit(groups))})
    return timed.groupBy("group").transformWithStateInPandas(ReviewRounds(keep // timedelta(microseconds=1)), schema, "Append", "EventTime")


def split_sink(ok: Column, good: str, bad: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows go to one of two Parquet tables."""

    def each(batch: DataFrame, _: int) -> None:
        fine = F.coalesce(ok, F.lit(False))
        batch.where(fine).write.mode("append").parquet(good)
        batch.where(~fine).write.mode("append").parquet(bad)

    return each


def decide_stream(df: DataFrame, columns: dict[str, str], rules: Rules, id: str, ts: str, out: str, audit: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for df's batches: decisions to one table, an audit row for each to another."""

    def each(batch: DataFrame, _: int) -> None:
        decided = decide(batch, rules=rules, **columns)
        decided.write.mode("append").parquet(out)
        append_audit(audit_rows(decided, F.lit("inspection.decided"), F.col(id), F.lit("stream"), F.col(ts)), audit)

    return each
