"""Stateful streams against plain replays, in several batchings and over restarts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.streaming import state as S
from tidemark.streaming import streams

START = datetime(2024, 1, 1)


def _folder(spark, tmp_path, rows: list[list[tuple]], schema: str):  # noqa: ANN001, ANN202
    """A file a batch, in order."""
    import os
    import time

    for k, some in enumerate(rows):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
        for f in (tmp_path / "in" / f"{k:03d}").iterdir():
            os.utime(f, (time.time() - 10_000 + k, time.time() - 10_000 + k))
    return spark.createDataFrame([], schema).schema


def _all(spark, tmp_path, schema, made, name: str, turns: int = 1):  # noqa: ANN001, ANN202
    S.with_state(spark)
    for _ in range(turns):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        streams.run_once(made(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")), str(tmp_path / "checkpoint"))
    return spark.read.parquet(str(tmp_path / "out")).collect()


def _cut(rows: list, n: int) -> list[list]:
    size = -(-len(rows) // n)
    return [rows[a : a + size] for a in range(0, len(rows), size)]


# -- clusters

VECTORS = "shard string, id long, ts timestamp, source string, embedding array<double>"


def _vectors(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    middle = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(4)]
    rows = []
    for k in range(160):
        m = rng.choice(middle)
        v = None if k % 41 == 0 else [0.0] * 5 if k % 37 == 0 else [x * (1 + k / 90) + rng.gauss(0, 0.35) for x in m]
        rows.append((rng.choice("ab"), k, START + timedelta(minutes=k // 2), rng.choice(("s", "t", None)), v))
    return rows


def _clusters(rows: list[tuple], most: int) -> dict:
    """All members of all clusters, as they come."""
    out, shards = {}, {}
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    for shard, k, _, source, v in sorted(rows, key=lambda r: (r[2], r[1])):
        s = shards.setdefault(shard, {"kept": [], "clusters": [], "seen": {}})
        source = source or "unknown"
        s["seen"][source] = s["seen"].get(source, 0) + 1
        gone = s["seen"][source] > most
        if v is None or np.linalg.norm(v) < 1e-6:
            out[k] = (shard, "skipped", None, None, gone)
            continue
        copy = next((i for i, w in s["kept"] if cos(v, w) >= 0.92), None)
        if copy is not None:
            out[k] = (shard, "duplicate", None, copy, gone)
            continue
        s["kept"].append((k, v))
        best = max(((cos(np.mean(c["m"], axis=0), v), -i) for i, c in enumerate(s["clusters"])), default=(-2, 0))
        if best[0] < 0.75:
            s["clusters"].append({"m": [v], "h": [np.array(v)]})
            out[k] = (shard, "new", len(s["clusters"]) - 1, None, gone)
            continue
        c = s["clusters"][-best[1]]
        c["m"].append(v)
        c["h"] = [*c["h"], np.mean(c["m"], axis=0)][-10:]
        if sum(np.linalg.norm(b - a) for a, b in zip(c["h"], c["h"][1:], strict=False)) > 0.5:
            c["m"].pop()
            c["h"][-1] = np.mean(c["m"], axis=0)
            s["clusters"].append({"m": [v], "h": [np.array(v)]})
            out[k] = (shard, "split", len(s["clusters"]) - 1, None, gone)
        else:
            out[k] = (shard, "attached", -best[1], None, gone)
    return out


@pytest.mark.parametrize("batches", [1, 3, 10])
def test_clusters_are_those_of_a_plain_fold(spark, tmp_path, batches):
    rows = _vectors(7)
    parts = _cut(rows, batches)
    schema = _folder(spark, tmp_path, parts, VECTORS)
    got = _all(spark, tmp_path, schema, lambda s: S.cluster_ingest(s, "shard", most=30), "clusters", turns=2)
    want = _clusters(rows, 30)
    assert {w[1] for w in want.values()} == {"skipped", "duplicate", "new", "attached", "split"}
    assert {r.id: (r.shard, r.action, r.cluster, r.duplicate_of, r.archived) for r in got} == want
    assert len(got) == len(rows)


def test_clusters_over_a_restart(spark, tmp_path):
    rows = _vectors(8)
    schema = _folder(spark, tmp_path, [rows[:70]], VECTORS)
    made = lambda s: S.cluster_ingest(s, "shard", most=30)
    _all(spark, tmp_path, schema, made, "before")
    spark.createDataFrame(rows[70:], VECTORS).coalesce(1).write.parquet(str(tmp_path / "in" / "999"))
    got = _all(spark, tmp_path, schema, made, "after")
    assert {r.id: (r.shard, r.action, r.cluster, r.duplicate_of, r.archived) for r in got} == _clusters(rows, 30)


# -- totals

EVENTS = "user long, ts timestamp, value double"


def _totals(rows: list[tuple]) -> dict:
    out: dict = {}
    for user, ts, value in rows:
        if ts is not None:
            out.setdefault((user, ts.replace(minute=0, second=0, microsecond=0)), []).append(value)
    real = {k: [x for x in v if x is not None] for k, v in out.items()}
    return {k: (len(v), sum(real[k]) if real[k] else None, min(real[k], default=None), max(real[k], default=None)) for k, v in out.items()}


def test_totals_are_those_of_one_pass_whatever_the_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice((1, 2, None)), START + timedelta(minutes=rng.randrange(600)), rng.choice((1.0, 2.5, None))) for _ in range(300)] + [(1, None, 4.0)]
    parts = _cut(rows, 5)
    for turn, order in enumerate(([0, 1, 2, 3, 4], [4, 2, 0, 1, 3], [0, 0, 1, 2, 1, 3, 4, 4])):
        made = S.WindowTotals(spark, f"file://{tmp_path}/{turn}", ["user"], "ts", "1 hour", "value")
        assert made.totals() is None
        numbers: dict = {}
        for step, k in enumerate(order):
            number = numbers.setdefault(k, len(numbers))
            made.write(spark.createDataFrame(parts[k], EVENTS), number)
            if step == 3:
                made.compact()
        got = made.totals().collect()
        assert {(r.user, r.start): (r.n, r.total, r.least, r.most) for r in got} == _totals(rows)
        before = made.compact()
        made.write(spark.createDataFrame(parts[0], EVENTS), before)  # comes again, and is held
        assert {(r.user, r.start): r.n for r in made.totals().collect()} == {k: v[0] for k, v in _totals(rows).items()}


def test_totals_of_a_stream(spark, tmp_path):
    rows = [(k % 3, START + timedelta(minutes=(k * 37) % 700), float(k)) for k in range(90)]
    schema = _folder(spark, tmp_path, _cut(rows, 4), EVENTS)
    made = S.WindowTotals(spark, f"file://{tmp_path}/totals", ["user"], "ts", "1 hour", "value")
    for _ in range(2):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        streams.run_once(stream.writeStream.foreachBatch(made.write), str(tmp_path / "checkpoint"))
    assert {(r.user, r.start): (r.n, r.total, r.least, r.most) for r in made.totals().collect()} == _totals(rows)


# -- cap


def test_cap_is_that_of_a_plain_replay(spark, tmp_path):
    rng = random.Random(5)
    rows = [(k, START + timedelta(seconds=rng.randrange(6000)), f"s{k % 7}") for k in range(200)]
    rows.sort(key=lambda r: r[1])
    rows = [r for k in range(0, 200, 10) for r in random.Random(k).sample(rows[k : k + 10], 10)]  # out of order, a little
    end = [(1000, START + timedelta(days=2), "end")]
    schema = _folder(spark, tmp_path, [*_cut(rows, 7), end, [(1001, START + timedelta(days=4), "end")]], "id long, ts timestamp, symbol string")
    got = _all(spark, tmp_path, schema, lambda s: S.rate_capped(s, 4, 900, "30 minutes"), "capped")
    passed, want = [], []
    for k, ts, symbol in sorted(rows + end, key=lambda r: (r[1], r[0])):
        passed = [t for t in passed if ts - t <= timedelta(seconds=900)]
        if len(passed) < 4:
            passed.append(ts)
            want.append((k, symbol))
    assert sorted((r.id, r.symbol) for r in got) == sorted(want)
    assert len(want) < 60


# -- buffer


def _buffered(parts: list[list[tuple]], ttl: timedelta, most: int) -> list[tuple]:
    held: dict = {}
    newest: dict = {}
    flushes: dict = {}
    out = []
    for part in parts:
        for user, k, ts, text in sorted(part, key=lambda r: (r[2], r[1])):
            rows = held.setdefault(user, {})
            if user in newest and ts <= newest[user] - ttl:
                out.append((user, k, text, "late", None))
                continue
            rows[ts, k] = text
            newest[user] = max(newest.get(user, ts), ts)
            if len(rows) > most:
                flushes[user] = flushes.get(user, 0) + 1
                for (t, i), x in sorted(rows.items()):
                    fate = "expired" if t <= newest[user] - ttl else "flushed"
                    out.append((user, i, x, fate, flushes[user] if fate == "flushed" else None))
                rows.clear()
        for user in {r[0] for r in part}:
            for t, i in sorted(held[user]):
                if t <= newest[user] - ttl:
                    out.append((user, i, held[user].pop((t, i)), "expired", None))
    return out


@pytest.mark.parametrize("batches", [1, 6])
def test_buffer_is_that_of_a_plain_replay(spark, tmp_path, batches):
    rng = random.Random(batches)
    rows = [(rng.choice((1, 1, 2)), k, START + timedelta(hours=6 * k - rng.choice((0, 0, 0, 30, 200))), f"t{k}") for k in range(150)]
    parts = _cut(rows, batches)
    schema = _folder(spark, tmp_path, parts, "user long, id long, ts timestamp, payload string")
    got = _all(spark, tmp_path, schema, lambda s: S.ttl_buffer(s, "user", 4, 10), "buffer", turns=2)
    want = _buffered(parts, timedelta(days=4), 10)
    assert sorted(((r.user, r.id, r.payload, r.fate, r.flush) for r in got), key=str) == sorted(want, key=str)
    assert {w[3] for w in want} >= {"flushed"}
    assert {r.id: r.ts for r in got} == {r[1]: r[2] for r in rows if r[1] in {w[1] for w in want}}
