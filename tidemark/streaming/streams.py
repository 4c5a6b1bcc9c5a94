"""Structured Streaming: event time instead of wall clock, state with a bound, invalid rows to a sink of their own."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def files(spark: SparkSession, path: str, schema: StructType, kind: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """New files of a folder, so many a trigger: back pressure, and the checkpoint is the mark of what was read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def once_per_id(events: DataFrame, id_col: str, ts: str, within: str = "1 hour") -> DataFrame:
    """The first of rows with equal ids that come within a time: the state is bounded by the watermark."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark([id_col])


def tumbling(events: DataFrame, ts: str, size: str, late: str, *by: str, value: str = "value") -> DataFrame:
    """(start, by, n, total, mean) of each window; rows later than `late` are dropped."""
    w = F.window(ts, size).alias("w")
    sums = events.withWatermark(ts, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return sums.select(F.col("w.start").alias("start"), *by, "n", "total", "mean")


def sliding(events: DataFrame, ts: str, size: str, step: str, late: str, *by: str) -> DataFrame:
    sums = events.withWatermark(ts, late).groupBy(F.window(ts, size, step).alias("w"), *by).agg(F.count("*").alias("n"))
    return sums.select(F.col("w.start").alias("start"), *by, "n")


def sessions(events: DataFrame, ts: str, gap: str, late: str, by: str) -> DataFrame:
    """(by, start, end, n): sessions that end after a gap; an event just at the gap still belongs."""
    sums = events.withWatermark(ts, late).groupBy(by, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return sums.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def cooldown(hits: DataFrame, by: str, ts: str, seconds: int, late: str = "1 hour") -> DataFrame:
    """(by, ts): of each key's times those that are `seconds` after the one let through before. The state is one time a key."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(x for b in batches for x in b[ts]):
            micros = int(t.value // 1000)
            if last is None or micros - last >= seconds * 1_000_000:
                out.append(t)
                last = micros
        state.update((last,))
        watermark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, watermark + 1) + 1)
        yield pd.DataFrame({by: [key[0]] * len(out), ts: out})

    kind = hits.schema[by].dataType.simpleString()
    rows = hits.select(by, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, late)
    return rows.groupBy(by).applyInPandasWithState(run, f"{by} {kind}, {ts} timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def alerts(metrics: DataFrame, rules: DataFrame, compare: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """Metrics that break a rule (name, op, threshold, ..): a stream joined with a small table that is read anew every trigger."""
    return metrics.join(rules, "name").where(compare(F.col("value"), F.col("op"), F.col("threshold")))


def split_invalid(df: DataFrame, valid: Column, good: Callable[[DataFrame], None], dead: Callable[[DataFrame], None], retries: int = 3, pause: float = 0.1) -> DataStreamWriter:
    """A writer whose batches go to `good`, and rows that aren't valid to `dead`. A sink that fails is tried again, at doubling pauses.

    Both sinks get a batch's rows under the same batch number after a restart, so they should replace by it.
    """

    def send(rows: DataFrame, sink: Callable[[DataFrame], None]) -> None:
        for turn in range(retries + 1):
            try:
                return sink(rows)
            except Exception:
                if turn == retries:
                    raise
                time.sleep(pause * 2**turn)

    def write(batch: DataFrame, number: int) -> None:
        held = batch.withColumn("batch", F.lit(number)).persist()
        try:
            send(held.where(F.coalesce(valid, F.lit(False))), good)
            send(held.where(~F.coalesce(valid, F.lit(False))), dead)
        finally:
            held.unpersist()

    return df.writeStream.foreachBatch(write)


def upsert(table: str, key: list[str], version: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a table of the latest row of each key, written beside the old one and put in its place.

    The old table is set aside, not deleted, until the new one has its name, so a driver may end between any two steps: the next batch
    first puts the newest whole table in place. A batch that comes again changes nothing. Each batch rewrites the table, so
    this is for tables that are small beside the stream; a reader may find no table for a moment.
    """
    from ..operators.dedup import upsert as merged

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at, new, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table + x) for x in ("", ".new", ".old"))
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}.new/_SUCCESS")

        def place() -> None:
            if fs.exists(at):
                fs.delete(old, True)
                fs.rename(at, old)
            if not fs.rename(new, at):
                raise OSError(f"{table}.new can't be renamed")
            fs.delete(old, True)

        if not fs.exists(at) and fs.exists(old):
            if fs.exists(done):
                place()
            else:
                fs.rename(old, at)
        before = spark.read.schema(batch.schema).parquet(table) if fs.exists(at) else batch.limit(0)
        merged(before, batch, key, version).write.mode("overwrite").parquet(f"{table}.new")
        place()

    return write


def run_once(writer: DataStreamWriter, checkpoint: str) -> None:
    """Reads all there is, in as many batches as it takes, and ends: what a scheduler calls."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def joined(left: DataFrame, right: DataFrame, key: str, ts: str, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows of two streams with the same key at most so far apart in time: both sides' state is bounded by the watermarks."""
    a = left.withWatermark(ts, late)
    b = right.select(F.col(key).alias("__tm_k"), F.col(ts).alias("right_ts"), *(c for c in right.columns if c not in (key, ts, *left.columns))).withWatermark("right_ts", late)
    near = F.expr(f"right_ts BETWEEN {ts} - INTERVAL {within} AND {ts} + INTERVAL {within}")
    return a.join(b, (F.col(key) == F.col("__tm_k")) & near).drop("__tm_k")
