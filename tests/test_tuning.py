"""Parameter search, cross-validated forests, and importance by shuffled columns."""

from __future__ import annotations

import random
import zlib
from datetime import datetime, timedelta

import numpy as np
import pytest

from tidemark.operators import learning as L
from tidemark.operators import market as K
from tidemark.operators.tuning import propose, search_lengths


@pytest.fixture(scope="module")
def candles(spark):
    rng = random.Random(3)
    rows = []
    for s in ("A", "B"):
        price = 100.0
        for k in range(160):
            price *= 1 + rng.gauss(0.0005, 0.02)
            rows.append((s, datetime(2024, 1, 1) + timedelta(days=k), price, price, price, price, 1.0))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")


def test_trials_in_one_pass_are_the_backtests_by_themselves(candles):
    got = {(r.symbol, r.fast, r.slow): (r.total_return, r.sharpe, r.max_drawdown, r.trades) for r in K.grid(candles, [3, 8], [8, 20]).collect()}
    assert len(got) == 6
    for fast, slow in ((3, 8), (3, 20), (8, 20)):
        for r in K.backtest_summary(K.simulate(K.sma_signal(candles, fast, slow)), "symbol").collect():
            assert got[r.symbol, fast, slow] == pytest.approx((r.total_return, r.sharpe, r.max_drawdown, r.trades), abs=1e-12)
    with pytest.raises(ValueError, match="slow"):
        K.grid(candles, [9], [5])


def test_search_is_seeded_and_its_values_are_the_grids(candles):
    a, b = (search_lengths(candles, range(3, 9), range(6, 30, 4), 3, 4, seed=5).collect() for _ in range(2))
    assert a == b
    assert len({(r.fast, r.slow) for r in a}) == len(a) == 12
    grid = K.grid(candles, list(range(3, 9)), list(range(6, 30, 4))).groupBy("fast", "slow").avg("total_return").collect()
    want = {(r.fast, r.slow): r["avg(total_return)"] for r in grid}
    assert all(abs(r.value - want[r.fast, r.slow]) < 1e-9 for r in a)
    assert [r.place for r in a] == sorted(r.place for r in a)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_search_is_no_worse_than_chance(seed):
    rng = np.random.default_rng(seed)
    top = rng.integers(5, 35, 2)
    curve = lambda a, b: -((a - top[0]) ** 2) - 0.5 * (b - top[1]) ** 2 + 3 * np.sin(a + b)
    values = (list(range(40)), list(range(40)))
    ours, chance = [], []
    for turn in range(5):
        done: dict = {}
        draw = np.random.default_rng(100 * seed + turn)
        for _ in range(6):
            for t in propose(values, lambda a, b: True, done, 8, draw):
                done[t] = float(curve(*t))
        ours.append(max(done.values()))
        some = np.random.default_rng(100 * seed + turn).permutation(1600)[: len(done)]
        chance.append(max(float(curve(k // 40, k % 40)) for k in some))
    assert np.mean(ours) >= np.mean(chance)


def test_small_grids_are_tried_whole():
    assert sorted(propose(([1, 2], [2, 3]), lambda a, b: b > a, {}, 10, np.random.default_rng(0))) == [(1, 2), (1, 3), (2, 3)]
    assert propose(([1], [2]), lambda a, b: b > a, {(1, 2): None}, 3, np.random.default_rng(0)) == []


def _facts(n: int) -> list[tuple]:
    rng = random.Random(9)
    rows = []
    for k in range(n):
        x, y = rng.random(), rng.random()
        rows.append((f"g{k % (n // 3)}", x, y, int((x > 0.5) != (rng.random() < 0.05))))
    return rows


def test_rows_are_predicted_out_of_their_fold(spark):
    rows = _facts(240)
    df = spark.createDataFrame(rows, "g string, x double, y double, label int")
    out, chosen = L.cross_validated(df, ["x", "y"], "g", trees=(3, 6), depths=(1, 3), leaves=(1,))
    got = out.collect()
    assert len(got) == len(rows)
    assert all(r.fold == zlib.crc32(r.g.encode()) % 3 for r in got)
    assert len(chosen["tried"]) == 4
    assert chosen["accuracy"] == max(chosen["tried"])
    assert np.mean([r.prediction == r.label for r in got]) > 0.85


def test_importance_is_that_of_the_column_that_decides(spark):
    df = spark.createDataFrame(_facts(240), "g string, x double, y double, label int")
    model = L.forest(df, ["x", "y"], trees=5, depth=3)
    lost = L.permutation_importance(model, df, ["x", "y"], repeats=2)
    assert lost["x"] > 0.25
    assert abs(lost["y"]) < 0.1
