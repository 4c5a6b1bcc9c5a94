"""The data source of klines and the table function of chunks."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import indexing, sessions
from tidemark.sources import klines
from tidemark.streaming import streams


def _write(folder, symbol: str, interval: str, name: str, first: int, n: int) -> list[tuple]:  # noqa: ANN001
    at = folder / f"symbol={symbol}" / f"interval={interval}"
    at.mkdir(parents=True, exist_ok=True)
    rows = [[str(1_700_000_000_000 + 60_000 * k), "1.5", "2", "1", str(k), "10", "x"] for k in range(first, first + n)]
    (at / f"{name}.json").write_text(json.dumps(rows))
    return [(symbol, interval, float(k)) for k in range(first, first + n)]


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "klines"
    want = [x for s in ("AB", "CD", "EF") for i in ("1m", "1h") for part in range(2) for x in _write(root, s, i, f"p{part}", 5 * part, 5)]
    (root / "symbol=AB" / "interval=1m" / "note.txt").write_text("no candles")
    (root / "symbol=AB" / "interval=1m" / "empty.json").write_text("")
    return root, want


def test_filters_choose_files_before_any_is_opened(spark, folder):
    root, want = folder
    klines.register(spark)
    df = spark.read.format("klines").load(str(root))
    every = df.collect()
    assert sorted((r.symbol, r.interval, r.close) for r in every) == sorted(want)
    assert df.rdd.getNumPartitions() == 13
    some = df.where("symbol = 'CD' AND interval IN ('1m', '5m') AND close > 3")
    assert some.rdd.getNumPartitions() == 2
    assert sorted(r.close for r in some.collect()) == [4.0, 5.0, 6.0, 7.0, 8.0, 9.0]
    (root / "symbol=EF" / "interval=1m" / "p0.json").write_text("this is no JSON")
    assert some.count() == 6
    assert df.where("symbol = 'AB' AND symbol = 'CD'").count() == 0
    with pytest.raises(Exception, match="path"):
        spark.read.format("klines").load().collect()


def test_stream_is_the_batch_and_reads_nothing_twice(spark, folder, tmp_path):
    root, want = folder
    klines.register(spark)

    def turn() -> list:
        stream = spark.readStream.format("klines").load(str(root))
        streams.run_once(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "checkpoint"))
        return sorted((r.symbol, r.interval, r.close) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert turn() == sorted(want)
    assert turn() == sorted(want)
    more = want + _write(root, "CD", "1m", "p9", 50, 3)
    assert turn() == sorted(more)
    batch = spark.read.format("klines").load(str(root)).select("symbol", "interval", "close")
    assert sorted(tuple(r) for r in batch.collect()) == sorted(more)


def test_chunks_by_sql_are_those_of_the_operator(spark):
    start = datetime(2024, 1, 1)
    rows = [(f"c{k % 3}", k, start + timedelta(minutes=4 * k + (k // 40) * 25), f"u{k % 4}", "Summary: so far" if k % 29 == 0 else None if k % 31 == 0 else "word " * (k % 17), k - 9 if k % 7 == 0 else None) for k in range(200)]
    df = spark.createDataFrame(rows, "chat string, id long, ts timestamp_ntz, author string, text string, reply_to long")
    df.createOrReplaceTempView("m")
    indexing.register(spark, "chunks_of_chats", most_tokens=60, gap_minutes=15, reply_gap_minutes=60)
    found = spark.sql("SELECT * FROM chunks_of_chats(TABLE(SELECT chat, id, ts, author, text, reply_to FROM m) PARTITION BY chat ORDER BY (ts, id))")
    got = {(r.chat, r.chunk_no): list(r.ids) for r in found.collect()}
    plain = sessions.chunks(df, "chat", "ts", "id", most_tokens=60, gap_minutes=15, reply_gap_minutes=60)
    want = {(r.chat, r.chunk_no): r.ids for r in plain.groupBy("chat", "chunk_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "id"))), lambda x: x["id"]).alias("ids")).collect()}
    assert got == want
    assert len(want) > 20
    assert spark.sql("SELECT * FROM chunks_of_chats(TABLE(SELECT chat, id, ts, author, text, reply_to FROM m WHERE id < 0) PARTITION BY chat ORDER BY (ts, id))").collect() == []
