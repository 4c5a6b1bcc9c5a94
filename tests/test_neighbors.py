"""The index of neighbours: recall and how much it looks at, exact where all is looked at, appends."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators.neighbors import NeighborIndex, _rows, fit
from tidemark.operators.vectors import nearest
from tidemark.shared import new_path


def _frame(spark, v: np.ndarray, first: int = 0):  # noqa: ANN001, ANN202
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"vec_id": np.arange(first, first + len(v)), "embedding": pa.array(list(v), pa.list_(pa.float64()))}))


def _best(v: np.ndarray, asked: np.ndarray, k: int) -> dict[int, set]:
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u[asked] @ u.T
    s[np.arange(len(asked)), asked] = -2
    return {int(a): set(np.argsort(-row, kind="stable")[:k].tolist()) for a, row in zip(asked, s, strict=True)}


def test_recall_while_few_rows_are_looked_at(spark):
    rng = np.random.default_rng(7)
    middle = rng.normal(size=(400, 32))
    v = middle[rng.integers(0, 400, 50_000)] + 0.5 * rng.normal(size=(50_000, 32))
    v[:20_000] = middle[0] + 0.5 * rng.normal(size=(20_000, 32))  # a hot direction
    df = _frame(spark, v)
    index = NeighborIndex.build(df, new_path(spark, "index"))
    cells = len(index.cells.fine)
    assert 150 < cells < 300
    asked = df.where("vec_id % 20 = 0")
    probes = cells // 10
    want = _best(v, np.arange(0, 50_000, 20), 10)
    got: dict[int, set] = {}
    for r in index.search(asked, 10, probes, 100).collect():
        got.setdefault(r.a, set()).add(r.b)
    assert np.mean([len(got[a] & b) / 10 for a, b in want.items()]) >= 0.9
    scored = index.candidates(asked, probes, 100).count()
    assert scored <= 100 * len(want)
    sizes = np.bincount([r.cell for r in index.rows().select("cell").collect()], minlength=cells)
    near = index.cells.nearest(v[::20] / np.linalg.norm(v[::20], axis=1, keepdims=True), probes)
    assert sizes[near].sum() < 0.3 * 50_000 * len(want)  # codes that are looked at; two fifths of the rows are one direction
    outside = ~np.isin(np.arange(0, 50_000, 20), np.arange(20_000))
    assert sizes[near][outside].sum() < 0.2 * 50_000 * outside.sum()


def test_all_cells_are_exact_and_appends_are_found(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(900, 8))
    df = _frame(spark, v)
    path = new_path(spark, "index")
    NeighborIndex.build(df.where("vec_id < 600"), path)
    index = NeighborIndex.at(spark, path)
    index.append(df.where("vec_id >= 600"), "1")
    index.append(df.where("vec_id >= 600"), "1")
    assert index.rows().count() == 900
    asked = df.where("vec_id % 20 = 0")
    got = {(r.a, r.b, r["rank"]): r.score for r in index.search(asked, 5, len(index.cells.fine), 900).collect()}
    want = {(r.a, r.b, r["rank"]): r.score for r in nearest(asked, df, 5).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (None, [1.0, 1.0]), (5, [0.0, 1.0]), (6, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = NeighborIndex.build(df, new_path(spark, "index"), cells=3)
    got = {r.a: (r.b, r.score) for r in index.search(df, 1, 9).collect()}
    assert got == {1: (2, 1.0), 2: (1, 1.0), 5: (6, 1.0), 6: (5, 1.0)}
    empty = NeighborIndex.build(df.limit(0), new_path(spark, "index"))
    assert empty.search(df, 3, 1).collect() == []
    assert len(fit(_rows(df, "vec_id", "embedding"), 4, 50).fine) <= 3


@pytest.mark.parametrize("probes", [1, 7])
def test_near_cells_are_nearly_the_nearest(spark, probes):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(100, 16))
    v = middle[rng.integers(0, 100, 8000)] + 0.3 * rng.normal(size=(8000, 16))
    made = fit(_rows(_frame(spark, v), "vec_id", "embedding"), 8000, 256)
    u = v[:500] / np.linalg.norm(v[:500], axis=1, keepdims=True)
    exact = np.argsort(-(u @ made.fine.T), axis=1)[:, :probes]
    got = made.nearest(u, probes)
    assert np.mean([len(set(a) & set(b)) / probes for a, b in zip(got, exact, strict=True)]) > 0.9
