"""Streams [P1-P3]: incremental keyed ingest, stepwise confirmation, source health."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from pitmart.sources.store import FactStore


def ingest(stream: DataFrame, store: FactStore, order: str, checkpoint: str, valid: str = "true", newest: bool = False, at: str | None = None, late: str = "7 days") -> StreamingQuery:
    """[P1] Each microbatch's valid rows are merged into a fact store, whose untouched buckets stay as they are; a batch
    that is delivered again is not merged again.  newest: a row older by `order` than what is there changes nothing.
    at: event time; a row that repeats, by its keys and order, within `late` of the first is dropped before the merge,
    and so is one older than the watermark, whose repeats are no longer known; that bounds the state."""
    rows = stream.where(valid)
    if at is not None:
        rows = rows.withWatermark(at, late).dropDuplicatesWithinWatermark([*store.keys, order])

    def step(batch: DataFrame, number: int) -> None:
        batch.persist()  # counted by bucket, then merged
        try:
            store.merge(batch, order, f"{checkpoint}#{number}", newest)
        finally:
            batch.unpersist()

    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def confirm_steps(stream: DataFrame, key: str, day: str, state: str, n: int = 2) -> DataFrame:
    """[P2] Row by row what `confirmed` gives in batch: the state per key is the confirmed one, the last raw one, how long
    it has run, and its day.  Rows of a microbatch are taken in order of the day; a day not after the last one is marked
    late and changes nothing."""
    schema = f"{key} string, {day} date, {state} string, confirmed string, late boolean"

    def step(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now, raw, run, last = held.get if held.exists else (None, None, 0, None)
        rows = pd.concat(list(frames)).sort_values(day, kind="stable")
        out = []
        for d, x in zip(rows[day], rows[state], strict=True):
            ordinal = pd.Timestamp(d).toordinal()
            late = last is not None and ordinal <= last
            if not late:
                run = run + 1 if x == raw else 1
                if raw is None or x == "UNKNOWN" or raw == "UNKNOWN" or run >= n:
                    now = x
                raw, last = x, ordinal
            out.append((k[0], d, x, now, late))
        held.update((now, raw, run, last))
        yield pd.DataFrame(out, columns=[key, day, state, "confirmed", "late"])

    return stream.groupBy(key).applyInPandasWithState(step, schema, "now string, raw string, run long, last long", "append", GroupStateTimeout.NoTimeout)


def summarised(events: DataFrame, source: str, at: str, failed: str) -> DataFrame:
    """Per source and part of the stream one summary: last success, last failure, and the distinct times of failures after
    that success with their counts.  Summaries merge in any order, so a source with very many events is reduced where its
    events are, before they shuffle."""
    schema = f"{source} string, {at} timestamp, last_success long, last_failure long, times array<long>, counts array<long>"

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.table({"source": batch.column(0), "at": batch.column(1).cast(pa.int64()), "bad": pc.fill_null(batch.column(2), True)})
            rows = rows.group_by(["source", "at", "bad"]).aggregate([([], "count_all")]).rename_columns(["source", "at", "bad", "n"])
            held = rows if held is None else pa.concat_tables([held, rows]).group_by(["source", "at", "bad"]).aggregate([("n", "sum")]).rename_columns(["source", "at", "bad", "n"])
            held = _since_success(held)
        if held is None or not held.num_rows:
            return
        out = held.sort_by([("source", "ascending"), ("at", "ascending")])
        names, first = np.unique(np.array(out["source"].to_pylist(), dtype=object).astype(str), return_index=True)
        cuts = [*first.tolist(), out.num_rows]
        time, bad, n = out["at"].to_numpy(), out["bad"].to_numpy(zero_copy_only=False), out["n"].to_numpy()
        columns: list[list] = [[], [], [], [], [], []]
        for name, a, z in zip(names, cuts[:-1], cuts[1:], strict=True):  # a source each
            good, wrong = time[a:z][~bad[a:z]], time[a:z][bad[a:z]]
            for column, value in zip(columns, (name, int(time[z - 1]), int(good.max()) if len(good) else None, int(wrong.max()) if len(wrong) else None, wrong.tolist(), n[a:z][bad[a:z]].tolist()), strict=True):
                column.append(value)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        arrays[1] = arrays[1].cast(pa.timestamp("us", tz="UTC"))
        yield pa.RecordBatch.from_arrays(arrays, [source, at, "last_success", "last_failure", "times", "counts"])

    return events.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias(source), F.col(at).cast("timestamp").alias(at), F.col(failed).cast("boolean").alias(failed)).where(F.col(at).isNotNull()).mapInArrow(reduce, schema)


def _since_success(rows: pa.Table) -> pa.Table:
    """Of each source its last success, its failures after it, and its last failure of all."""
    good = rows.filter(pc.invert(rows["bad"])).group_by("source").aggregate([("at", "max")]).rename_columns(["source", "good"])
    worst = rows.filter(rows["bad"]).group_by("source").aggregate([("at", "max")]).rename_columns(["source", "worst"])
    both = rows.join(good, "source", join_type="left outer").join(worst, "source", join_type="left outer")
    after = pc.fill_null(pc.greater(both["at"], both["good"]), True)
    kept = pc.if_else(both["bad"], pc.or_(after, pc.equal(both["at"], both["worst"])), pc.equal(both["at"], both["good"]))
    return both.filter(pc.fill_null(kept, False)).select(["source", "at", "bad", "n"])


class _Health(StatefulProcessor):
    """Merges summaries by source.  Failures not newer than the watermark become a count, as no earlier success can come any
    more; the state thus holds the failure times of the allowed lateness alone.  A source without any event for `idle` is
    reported once with that."""

    _STATE = "good long, bad long, settled long, times array<long>, counts array<long>"

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("health", self._STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        good, bad, settled, times, counts = self.held.get() if self.held.exists() else (None, None, 0, [], [])
        at, n = [np.array(times, dtype=np.int64)], [np.array(counts, dtype=np.int64)]
        for frame in rows:
            good = max((int(x) for x in (good, frame["last_success"].max()) if x is not None and not pd.isna(x)), default=None)
            bad = max((int(x) for x in (bad, frame["last_failure"].max()) if x is not None and not pd.isna(x)), default=None)
            at += [np.asarray(x, dtype=np.int64) for x in frame["times"]]
            n += [np.asarray(x, dtype=np.int64) for x in frame["counts"]]
        time, each = np.concatenate(at), np.concatenate(n)
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        if good is not None:
            if good > mark:  # later than all that is settled
                settled = 0
            time, each = time[time > good], each[time > good]
        settled += int(each[time <= mark].sum())
        time, each = time[time > mark], each[time > mark]
        time, of = np.unique(time, return_inverse=True)
        each = np.bincount(of, weights=each, minlength=len(time)).astype(np.int64)
        self.held.update((good, bad, settled, time.tolist(), each.tolist()))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            last = max(x for x in (good, bad) if x is not None) // 1000
            self.handle.registerTimer(max(last, timerValues.getCurrentWatermarkInMs()) + self.idle_ms)
        yield self._row(key, good, bad, settled + int(each.sum()), False)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        good, bad, settled, _, counts = self.held.get()
        yield self._row(key, good, bad, settled + int(sum(counts)), True)

    def _row(self, key: tuple, good: int | None, bad: int | None, n: int, idle: bool) -> pd.DataFrame:
        when = lambda x: pd.NaT if x is None else pd.Timestamp(x, unit="us")
        return pd.DataFrame({"source": [key[0]], "last_success": [when(good)], "last_failure": [when(bad)], "failures_in_a_row": [n], "idle": [idle]}).astype({"last_success": "datetime64[us]", "last_failure": "datetime64[us]"})

    def close(self) -> None:
        pass


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which state by processor needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def source_health(stream: DataFrame, source: str, at: str, failed: str, late: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """[P3] Per source after each microbatch that has events of it: last success, last failure, failures in a row since, equal
    to health_rollup over all that came so far, in any order within `late`; idle: one more row once the watermark has
    passed the last event by idle_ms.  Needs Spark's RocksDB state store (rocksdb())."""
    parts = summarised(stream, source, at, failed).withWatermark(at, late)
    schema = "source string, last_success timestamp, last_failure timestamp, failures_in_a_row long, idle boolean"
    out = parts.groupBy(source).transformWithStateInPandas(statefulProcessor=_Health(idle_ms), outputStructType=schema, outputMode="Update", timeMode="EventTime")
    return out.withColumnRenamed("source", source)


def health_rollup(events: DataFrame, source: str, at: str, failed: str) -> DataFrame:
    """[A9] The same of a whole table: failures after the last success.  Both passes sum before they shuffle; the last
    times, one row a source, are a side that Spark broadcasts by its size."""
    last = events.groupBy(source).agg(F.max(F.when(~F.col(failed), F.col(at))).alias("last_success"), F.max(F.when(F.col(failed), F.col(at))).alias("last_failure"))
    times = events.where(failed).groupBy(source, at).agg(F.count("*").alias("_n"))
    later = times.join(last.select(source, "last_success"), source).where(F.col("last_success").isNull() | (F.col(at) > F.col("last_success")))
    return last.join(later.groupBy(source).agg(F.sum("_n").alias("_n")), source, "left").select(source, "last_success", "last_failure", F.coalesce("_n", F.lit(0)).alias("failures_in_a_row"))
