"""Streams give what batches give on the same rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import telemetry as T
from tidemark.streaming import streams as S


@pytest.fixture
def folder(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=7 * k), k % 3, float(k)) for k in range(120)] + [(5, start + timedelta(minutes=35), 2, 5.0)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, user long, value double")
    for k in range(4):
        df.where(F.col("id") % 4 == k).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    return tmp_path, df


def _run(spark, tmp_path, df, name, mode="append"):
    out = str(tmp_path / name)
    S.run_once(df.writeStream.format("memory").queryName(name).outputMode(mode), out + "-checkpoint")
    return spark.table(name)


def _stream(spark, tmp_path, df):
    return S.files(spark, str(tmp_path / "in"), df.schema, per_trigger=100)


def test_each_id_comes_once(spark, folder):
    tmp_path, df = folder
    got = _run(spark, tmp_path, S.once_per_id(_stream(spark, tmp_path, df), "id", "ts", "30 days"), "once")
    assert sorted(r.id for r in got.collect()) == list(range(120))


def test_windows_are_the_batch_ones(spark, folder):
    tmp_path, df = folder
    got = _run(spark, tmp_path, S.tumbling(_stream(spark, tmp_path, df), "ts", "1 hour", "30 days", "user"), "tumbling", "complete")
    want = df.groupBy(F.window("ts", "1 hour").alias("w"), "user").agg(F.count("*").alias("n"), F.sum("value").alias("t")).collect()
    assert sorted((r.start, r.user, r.n, r.total) for r in got.collect()) == sorted((r.w.start, r.user, r.n, r.t) for r in want)
    got = _run(spark, tmp_path, S.sliding(_stream(spark, tmp_path, df), "ts", "1 hour", "30 minutes", "30 days"), "sliding", "complete")
    assert sum(r.n for r in got.collect()) == 2 * df.count()
    got = _run(spark, tmp_path, S.sessions(_stream(spark, tmp_path, df), "ts", "21 minutes", "30 days", "user"), "sessions", "complete")
    assert {(r.user, r.n) for r in got.collect()} == {(0, 40), (1, 40), (2, 41)}


def test_cooldown_is_the_batch_one(spark, folder):
    tmp_path, df = folder
    got = _run(spark, tmp_path, S.cooldown(_stream(spark, tmp_path, df), "user", "ts", 3600, "30 days"), "cooldown")
    want = T.cooled(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), ["user"], "ts", F.first(F.lit(60))).collect()
    assert sorted((r.user, r.ts) for r in got.collect()) == sorted((r.user, r.ts) for r in want)


def test_invalid_rows_and_failing_sinks(spark, folder):
    tmp_path, df = folder
    failures = iter([1, 1])

    def flaky(rows):
        if next(failures, None):
            raise OSError("not yet")
        rows.write.mode("append").parquet(str(tmp_path / "good"))

    writer = S.split_invalid(_stream(spark, tmp_path, df), F.col("value") < 100, flaky, lambda rows: rows.write.mode("append").parquet(str(tmp_path / "dead")), pause=0.01)
    S.run_once(writer, str(tmp_path / "split-checkpoint"))
    assert spark.read.parquet(str(tmp_path / "good")).count() == 101
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 20


def test_upsert_keeps_the_latest(spark, folder):
    tmp_path, df = folder
    stream = S.files(spark, str(tmp_path / "in"), df.schema, per_trigger=1)
    S.run_once(stream.writeStream.foreachBatch(S.upsert(str(tmp_path / "latest"), ["user"], "ts")), str(tmp_path / "upsert-checkpoint"))
    got = spark.read.parquet(str(tmp_path / "latest")).collect()
    assert {r.user: r.id for r in got} == {0: 117, 1: 118, 2: 119}


@pytest.mark.parametrize("whole", [True, False])
def test_upsert_that_was_cut_off_loses_no_key(spark, tmp_path, whole):
    """The driver ended after the old table was set aside, with the new one whole or not."""
    table, rows = str(tmp_path / "t"), lambda *x: spark.createDataFrame(list(x), "user long, ts long")
    write = S.upsert(table, ["user"], "ts")
    write(rows((1, 1), (2, 1)), 0)
    (tmp_path / "t").rename(tmp_path / "t.old")
    rows((1, 5), (2, 1)).write.parquet(f"{table}.new")
    if not whole:
        (tmp_path / "t.new" / "_SUCCESS").unlink()
    write(rows((3, 2)), 2)
    assert {r.user: r.ts for r in spark.read.parquet(table).collect()} == {1: 5 if whole else 1, 2: 1, 3: 2}
    assert not (tmp_path / "t.old").exists()


def test_alerts_join_rules(spark, folder):
    tmp_path, df = folder
    rules = spark.createDataFrame([("m", ">", 117.0), ("x", "<", 0.0)], "name string, op string, threshold double")
    metrics = _stream(spark, tmp_path, df).withColumn("name", F.lit("m"))
    got = _run(spark, tmp_path, S.alerts(metrics, rules, T.compare).select("id"), "alerts")
    assert sorted(r.id for r in got.collect()) == [118, 119]


def test_two_streams_meet_within_a_time(spark, folder):
    tmp_path, df = folder
    left = _stream(spark, tmp_path, df)
    right = _stream(spark, tmp_path, df).select("id", "ts", (F.col("value") * 2).alias("double_value"))
    got = _run(spark, tmp_path, S.joined(left, right, "id", "ts", "1 minute", "30 days").select("id", "double_value"), "joined")
    assert {r.id: r.double_value for r in got.collect()} == {k: 2.0 * k for k in range(120)}
