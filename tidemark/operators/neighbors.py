"""An index of vectors for their nearest neighbours by cosine: two levels of cells, codes of a byte a number, appends without a rebuild.

About sqrt(n) cells are fitted on a sample: coarse ones on the driver, the fine ones of each coarse cell in a task of its own. Every
vector belongs to its nearest cell. A search ranks the vectors of a query's nearest cells by their codes, a block of queries against a block
of vectors at a time, and scores only the best of those with the vectors themselves.

The index is a folder: `centers`, `rows` (id, cell, v) and `blocks` (cell, ids, codes, scales), the last two with a folder for each batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import materialized

#: Rows that coarse cells are fitted on at most, and rows that fine ones are fitted on for each of them; by the hash of the id.
SAMPLE, EACH = 20_000, 64
#: Cells at most, of a sample of EACH times as many: what is broadcast are their centers.
MOST_CELLS = 16_384
#: Vectors in a block of the index, queries in a block of a search.
BLOCK, ASKED = 4096, 256
_HASHES = 1 << 32


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places of vectors that have a direction, those vectors at length 1)."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    v = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1) if len(lists) else np.empty((0, 0))
    size = np.linalg.norm(v, axis=1)
    some = np.flatnonzero(np.isfinite(size) & (size > 0))
    return some, v[some] / size[some, None]


def _means(v: np.ndarray, k: int, seed: int, turns: int = 12) -> np.ndarray:
    """Centers of at most k groups of unit vectors, by k-means on directions."""
    distinct = np.unique(v, axis=0)
    centers = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(turns):
        own = np.concatenate([(v[a : a + 8192] @ centers.T).argmax(axis=1) for a in range(0, len(v), 8192)])
        sums = np.zeros_like(centers)
        np.add.at(sums, own, v)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(size > 0, sums / np.where(size > 0, size, 1), centers)
    return centers


@dataclass
class Cells:
    """Centers of coarse cells; centers of all cells, and which coarse one each is in."""

    coarse: np.ndarray
    fine: np.ndarray
    owner: np.ndarray

    def nearest(self, v: np.ndarray, probes: int) -> np.ndarray:
        """The `probes` nearest cells of each unit vector; for few probes only cells in near coarse cells are looked at."""
        if probes * 8 >= len(self.fine):
            return np.argsort(-(v @ self.fine.T), axis=1, kind="stable")[:, :probes]
        sizes = np.bincount(self.owner, minlength=len(self.coarse))
        near = np.argsort(-(v @ self.coarse.T), axis=1, kind="stable")
        need = (np.cumsum(sizes[near], axis=1) < max(8 * probes, len(self.fine) // 4)).sum(axis=1) + 1  # coarse cells that hold enough
        order = np.argsort(self.owner, kind="stable")
        starts = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty((len(v), probes), np.int64)
        for r in range(len(v)):
            some = np.concatenate([order[starts[c] : starts[c + 1]] for c in near[r, : need[r]]])
            score = self.fine[some] @ v[r]
            best = np.argpartition(-score, probes - 1)[:probes]
            out[r] = some[best[np.lexsort((some[best], -score[best]))]]
        return out


def _rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    return vectors.where(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))


def _sampled(rows: DataFrame, n: int, most: int, seed: int) -> DataFrame:
    """About `most` rows, those of the smallest hashes."""
    bound = _HASHES if n <= most else int(_HASHES * (most / n))
    return rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(_HASHES)) < bound)


def fit(rows: DataFrame, n: int, cells: int | None = None, seed: int = 0) -> Cells:
    """Cells for n rows (id, v): sqrt(n) of them unless given, at most MOST_CELLS."""
    cells = max(1, min(MOST_CELLS, round(n**0.5) if cells is None else cells))
    some = _sampled(rows, n, SAMPLE // 2, seed).select("v").limit(SAMPLE).toArrow()
    _, v = _units(some.column("v"))
    if not len(v):
        return Cells(np.empty((0, 0)), np.empty((0, 0)), np.empty(0, np.int64))
    coarse = _means(v, max(1, round(cells**0.5)), seed)
    spark = rows.sparkSession
    middle = spark.sparkContext.broadcast(coarse)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, unit = _units(batch.column("v"))
            if len(at):
                own = (unit @ middle.value.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(list(unit), pa.list_(pa.float64()))], names=["owner", "v"])

    placed = materialized(_sampled(rows, n, EACH * cells, seed + 1).mapInArrow(place, "owner int, v array<double>"), "sample")
    share = cells / max(1, placed.count())

    def split(table: pa.Table) -> pa.Table:
        _, unit = _units(table.column("v"))
        found = _means(unit, max(1, round(len(unit) * share)), seed)
        return pa.table({"owner": pa.array(np.full(len(found), table.column("owner")[0].as_py(), np.int32)), "center": pa.array(list(found), pa.list_(pa.float64()))})

    fine = placed.groupBy("owner").applyInArrow(split, "owner int, center array<double>").orderBy("owner", "center").collect()
    if not fine:
        return Cells(coarse, coarse, np.arange(len(coarse)))
    return Cells(coarse, np.array([r.center for r in fine], float), np.array([r.owner for r in fine], np.int64))


def _probed(cells: Broadcast, probes: int):  # noqa: ANN202
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, unit = _units(batch.column("v"))
            if not len(at):
                continue
            near = cells.value.nearest(unit, probes)
            row = np.repeat(np.arange(len(at)), near.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at[row])), pa.array(near.reshape(-1).astype(np.int32)), pa.array(list(unit[row]), pa.list_(pa.float64()))], names=["id", "cell", "v"])

    return run


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of neighbouring rows of a cell: ids, codes of a byte a number, and what a code of 127 stands for."""

    def block(cell: int, ids: list, rows: list) -> pa.RecordBatch:
        v = np.array(rows, float)
        scale = np.abs(v).max(axis=1) / 127
        codes = np.round(v / scale[:, None]).astype(np.int8)
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary()), pa.array([scale.astype(np.float32).tobytes()], pa.binary())], names=["cell", "ids", "codes", "scales"])

    now, ids, rows = None, [], []
    for batch in batches:
        for cell, k, v in zip(batch.column("cell").to_pylist(), batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
            if ids and (cell != now or len(ids) == BLOCK):
                yield block(now, ids, rows)
                ids, rows = [], []
            now = cell
            ids.append(k)
            rows.append(v)
    if ids:
        yield block(now, ids, rows)


def _asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of queries of a cell: ids and vectors."""
    now, ids, rows = None, [], []
    block = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array(rows, np.float32).tobytes()], pa.binary())], names=["cell", "asks", "queries"])
    for batch in batches:
        for cell, k, v in zip(batch.column("cell").to_pylist(), batch.column("id").to_pylist(), batch.column("v").to_pylist(), strict=True):
            if ids and (cell != now or len(ids) == ASKED):
                yield block()
                ids, rows = [], []
            now = cell
            ids.append(k)
            rows.append(v)
    if ids:
        yield block()


def _first_pass(refine: int):  # noqa: ANN202
    """Of a block of queries and one of vectors each query's `refine` best other rows, by codes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[k].as_buffer(), kind)  # noqa: B023, E731
                asks, ids, scale = get("asks", np.int64), get("ids", np.int64), get("scales", np.float32)
                q, codes = get("queries", np.float32).reshape(len(asks), -1), get("codes", np.int8).reshape(len(ids), -1)
                guess = (q @ codes.T.astype(np.float32)) * scale
                guess[asks[:, None] == ids[None, :]] = -2
                m = min(refine, len(ids))
                best = np.argpartition(-guess, m - 1, axis=1)[:, :m]
                row = np.repeat(np.arange(len(asks)), m)
                value = guess[row, best.reshape(-1)]
                ok = value > -2
                yield pa.RecordBatch.from_arrays([pa.array(asks[row][ok]), pa.array(ids[best.reshape(-1)][ok]), pa.array(value[ok])], names=["a", "b", "guess"])

    return run


class NeighborIndex:
    """Built once (`build`), added to (`append`), searched (`search`); `at` opens one that is there."""

    def __init__(self, spark: SparkSession, path: str, cells: Cells) -> None:
        self.spark, self.path, self.cells = spark, path, cells

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 0) -> NeighborIndex:
        """Fits cells, keeps them, and adds all vectors as the batch `0`."""
        spark, rows = vectors.sparkSession, _rows(vectors, id_col, vec_col)
        made = fit(rows, rows.count(), cells, seed)
        listed = [("coarse", k, -1, c.tolist()) for k, c in enumerate(made.coarse)] + [("fine", k, int(o), c.tolist()) for k, (c, o) in enumerate(zip(made.fine, made.owner, strict=True))]
        spark.createDataFrame(listed, "level string, place int, owner int, center array<double>").write.parquet(f"{path}/centers")
        index = cls(spark, path, made)
        index.append(vectors, "0", id_col, vec_col)
        return index

    @classmethod
    def at(cls, spark: SparkSession, path: str) -> NeighborIndex:
        rows = spark.read.parquet(f"{path}/centers").orderBy("level", "place").collect()
        level = lambda name: np.array([r.center for r in rows if r.level == name], float)
        return cls(spark, path, Cells(level("coarse"), level("fine"), np.array([r.owner for r in rows if r.level == "fine"], np.int64)))

    def append(self, vectors: DataFrame, batch: str, id_col: str = "vec_id", vec_col: str = "embedding") -> None:
        """Adds vectors to their cells; cells stay as they are. A batch that is there is left as it is: it may be sent again.

        Null and zero vectors aren't indexed. Cells are dealt to tasks by ranges of (cell, id), so that a large one is split.
        """
        target = f"{self.path}/blocks/batch={batch}"
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
        if at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return
        if not len(self.cells.fine):
            placed = self.spark.createDataFrame([], "id long, cell int, v array<double>")
        else:
            placed = _rows(vectors, id_col, vec_col).mapInArrow(_probed(self.spark.sparkContext.broadcast(self.cells), 1), "id long, cell int, v array<double>")
        placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        rows = self.spark.read.schema("id long, cell int, v array<double>").parquet(f"{self.path}/rows/batch={batch}")
        rows.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").mapInArrow(_packed, "cell int, ids binary, codes binary, scales binary").write.mode("overwrite").parquet(target)

    def rows(self) -> DataFrame:
        return self.spark.read.schema("id long, cell int, v array<double>").parquet(f"{self.path}/rows")

    def blocks(self) -> DataFrame:
        return self.spark.read.schema("cell int, ids binary, codes binary, scales binary").parquet(f"{self.path}/blocks")

    def candidates(self, queries: DataFrame, probes: int, refine: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """(a, b): the `refine` rows of another id in each query's `probes` nearest cells whose codes are nearest."""
        cells = self.spark.sparkContext.broadcast(self.cells)
        asked = _rows(queries, id_col, vec_col).mapInArrow(_probed(cells, min(probes, len(self.cells.fine))), "id long, cell int, v array<double>")
        asked = asked.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").mapInArrow(_asked, "cell int, asks binary, queries binary")
        met = asked.join(self.blocks(), "cell").select("asks", "queries", "ids", "codes", "scales")
        found = met.mapInArrow(_first_pass(refine), "a long, b long, guess float")
        place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("guess"), "b"))
        return found.withColumn("place", place).where(F.col("place") <= refine).select("a", "b")

    def search(self, queries: DataFrame, k: int, probes: int, refine: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
        """(a, b, score, rank): each query's `k` nearest rows of another id among its candidates; cosines as such.

        With as many probes as there are cells, and `refine` not below the number of rows, it is exact. Queries without a direction find nothing;
        an id that is in the index more than once counts once for each.
        """
        if not len(self.cells.fine):
            return self.spark.createDataFrame([], "a long, b long, score double, rank int")
        asked = _rows(queries, id_col, vec_col).select(F.col("id").alias("a"), F.col("v").alias("q"))
        met = self.candidates(queries, probes, max(k, refine), id_col, vec_col).join(self.rows().select(F.col("id").alias("b"), "v"), "b").join(asked, "a")
        product = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
        scored = met.select("a", "b", F.round(product("q", "v") / F.sqrt(product("q", "q")), 12).alias("score"))
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k)
