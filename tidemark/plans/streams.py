"""Streams, read once to their end: what each gives over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import new_path
from ..sources.tables import load
from ..streaming import state, streams
from .registry import query


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files as a stream; timestamps with a zone, which watermarks ask for."""
    schema = load(spark, d, name).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"})


def _in_parts(spark: SparkSession, table: DataFrame, n: int = 4) -> DataFrame:
    """A table as a stream of n batches, whose rows are those of no order."""
    path = new_path(spark, "parts")
    table.repartition(n, *table.columns[:1]).write.parquet(path)
    return streams.files(spark, path, table.schema, per_trigger=1)


def _in_time(spark: SparkSession, table: DataFrame, n: int = 4) -> DataFrame:
    """A table as a stream of n batches in order of time."""
    path, at = new_path(spark, "parts"), F.unix_micros("ts")
    cuts = table.select(at.cast("double").alias("t")).approxQuantile("t", [k / n for k in range(1, n)], 0.01)
    for k, (a, b) in enumerate(zip([float("-inf"), *cuts], [*cuts, float("inf")], strict=True)):
        table.where((at >= a) & (at < b)).write.parquet(f"{path}/{k}")
    return streams.files(spark, f"{path}/*", table.schema, per_trigger=1)


def _read_out(df: DataFrame, mode: str = "append") -> DataFrame:
    """All that a stream gives, as a table. In complete mode the last batch stands for all."""
    spark, out = df.sparkSession, new_path(df.sparkSession, "stream")
    if mode == "append":
        writer = df.writeStream.format("parquet").option("path", out)
    else:
        writer = df.writeStream.outputMode(mode).foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(out))
    streams.run_once(writer, new_path(spark, "checkpoint"))
    return spark.read.schema(df.schema).parquet(out)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain_time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("SELECT event_id, min(user_id) AS user_id FROM events GROUP BY 1")
def stream_once_per_id(spark: SparkSession, d: str) -> DataFrame:
    """Each event comes in two batches and leaves once."""
    e = _events(spark, d).select("event_id", "ts", "user_id")
    return _read_out(streams.once_per_id(_in_parts(spark, e.union(e)), "event_id", "ts", "3650 days")).select("event_id", "user_id")


@query("SELECT date_trunc('hour', ts) AS start, user_id, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = _read_out(streams.tumbling(_in_parts(spark, _events(spark, d)), "ts", "1 hour", "3650 days", "user_id"), "complete")
    return _plain_time(out, "start").withColumns({"total": F.round("total", 4), "mean": F.round("mean", 4)})


@query("""
WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, ts FROM events WHERE event_type = 'error'),
  r AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY 1
        UNION ALL
        SELECT e.user_id, min(e.ts) FROM r JOIN e ON e.user_id = r.user_id AND e.ts >= r.ts + INTERVAL 6 HOUR GROUP BY e.user_id)
SELECT user_id, ts FROM r""")
def stream_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """A user's errors, one in six hours."""
    hits = _stream(spark, d, "events").where("event_type = 'error'").select("user_id", "ts")
    return _plain_time(_read_out(streams.cooldown(hits, "user_id", "ts", 6 * 3600, "3650 days")), "ts")


@query()
def stream_rate_cap(spark: SparkSession, d: str) -> DataFrame:
    """Of all events at most 3 in a quarter of an hour; those of the last batch still wait. Tests hold it against a plain replay."""
    hits = _in_time(state.with_state(spark), _events(spark, d).select(F.col("event_id").alias("id"), "ts", "user_id"))
    return _plain_time(_read_out(state.rate_capped(hits, 3, 900, "1 hour")), "ts")


@query("""
SELECT user_id, date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY 1, 2""")
def stream_window_totals(spark: SparkSession, d: str) -> DataFrame:
    """Batches of no order, so that nearly every row is late: totals are those of one pass."""
    made = state.WindowTotals(spark, new_path(spark, "totals"), ["user_id"], "ts", "1 day", "value")
    streams.run_once(_in_parts(spark, _events(spark, d)).writeStream.foreachBatch(made.write), new_path(spark, "checkpoint"))
    made.compact()
    out = made.totals().select("user_id", "start", "n", F.round("total", 4).alias("total"), F.round("mean", 4).alias("mean"), "least", "most")
    return _plain_time(out, "start")


@query()
def stream_ttl_buffer(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events, for two days at most, flushed beyond 20. Tests hold it against a plain replay."""
    rows = _stream(spark, d, "events").select("user_id", F.col("event_id").alias("id"), "ts", F.col("event_type").alias("payload"))
    spark = state.with_state(spark)
    return _plain_time(_read_out(state.ttl_buffer(rows, "user_id", 2, 20)), "ts")


@query()
def stream_cluster_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Vectors, a shard for each label, in order of ids. Tests hold it against a plain fold."""
    rows = _stream(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.timestamp_seconds("vec_id").alias("ts"), F.lit("given").alias("source"), "embedding")
    spark = state.with_state(spark)
    return _read_out(state.cluster_ingest(rows, "label", same=0.4, near=0.2, most=100))


@query("SELECT event_id, event_type AS name, value FROM events WHERE (event_type = 'error' AND value > 40) OR (event_type = 'purchase' AND value < 10)")
def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Events that break a rule of a small table."""
    rules = spark.createDataFrame([("error", ">", 40.0), ("purchase", "<", 10.0)], "name string, op string, threshold double")
    metrics = _stream(spark, d, "events").select("event_id", F.col("event_type").alias("name"), "value")
    compare = lambda v, op, t: F.when(op == ">", v > t).otherwise(v < t)
    return _read_out(streams.alerts(metrics, rules, compare).select("event_id", "name", "value"))


@query("SELECT event_id, CASE WHEN value < 20 THEN 'dead' ELSE 'good' END AS sink FROM events")
def stream_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    """Rows that aren't valid go to a sink of their own; both sinks fail once."""
    out, left = new_path(spark, "sinks"), {"good": 1, "dead": 1}

    def sink(name: str) -> Callable[[DataFrame], None]:
        def write(rows: DataFrame) -> None:
            if left[name]:
                left[name] -= 1
                raise OSError("the sink is away")
            rows.select("event_id", F.lit(name).alias("sink")).write.mode("overwrite").parquet(f"{out}/sink_{name}")

        return write

    writer = streams.split_invalid(_stream(spark, d, "events"), F.col("value") >= 20, sink("good"), sink("dead"), pause=0.01)
    streams.run_once(writer, new_path(spark, "checkpoint"))
    return spark.read.schema("event_id long, sink string").parquet(f"{out}/sink_good", f"{out}/sink_dead")


@query("""
SELECT a.event_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase'
  AND b.ts BETWEEN a.ts - INTERVAL 1 HOUR AND a.ts + INTERVAL 1 HOUR""")
def stream_joined(spark: SparkSession, d: str) -> DataFrame:
    """Clicks and purchases of a user within an hour of each other."""
    clicks = _stream(spark, d, "events").where("event_type = 'click'").select("user_id", "ts", "event_id")
    bought = _stream(spark, d, "events").where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return _read_out(streams.joined(clicks, bought, "user_id", "ts", "1 hour", "3650 days").select("event_id", "purchase_id"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Batches of no order: each user's latest event stays."""
    table = new_path(spark, "upserted")
    rows = _events(spark, d).select("user_id", "event_id", "ts", F.struct("ts", "event_id").alias("version"))
    streams.run_once(_in_parts(spark, rows).writeStream.foreachBatch(streams.upsert(table, ["user_id"], "version")), new_path(spark, "checkpoint"))
    return _plain_time(spark.read.parquet(table).select("user_id", "event_id", "ts"), "ts")
