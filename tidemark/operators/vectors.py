"""Operators on tables of vectors: similarity joins in blocks, clusters, medoids, drift."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import distance

#: Vectors in a block: two blocks are held against each other in one task.
BLOCK = 2048
#: Products or distances that a task holds at once.
CELLS = 1 << 20


def _units(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that have finite numbers, and all as unit vectors; a zero vector stays one."""
    lists = table.column("v").combine_chunks()
    v = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
    return np.flatnonzero(np.isfinite(v).all(axis=1) & np.isfinite(size[:, 0])), v


def _exact(v: np.ndarray, w: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of pairs to twelve digits."""
    out = np.empty(len(i))
    for at in range(0, len(i), 1 << 16):
        some = slice(at, at + (1 << 16))
        out[some] = np.einsum("ij,ij->i", v[i[some]], w[j[some]])
    return np.round(out, 12)


def _strips(v: np.ndarray, w: np.ndarray) -> Iterator[tuple[int, np.ndarray, float]]:
    """Products in single precision, so many rows at once as `CELLS` allows: (first row, products, what they may be off by)."""
    a, b = v.astype(np.float32), w.astype(np.float32)
    step = max(1, CELLS // max(1, len(b)))
    for at in range(0, len(a), step):
        yield at, a[at : at + step] @ b.T, (v.shape[1] + 16) * 2.0**-23


def _reaching(v: np.ndarray, w: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, score) of all pairs with cosine `least` or more, strip by strip: single precision names candidates."""
    for at, s, off in _strips(v, w):
        i, j = np.divmod(np.flatnonzero(s >= np.float32(least - off)), s.shape[1])
        score = _exact(v, w, i + at, j)
        yes = score >= least
        yield i[yes] + at, j[yes], score[yes]


def _nearest_of(v: np.ndarray, w: np.ndarray, ids: np.ndarray, others: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of each row's `k` nearest of another id, ties by id: only what may be among them is looked at in double precision."""
    found = []
    groups = max(16, 4 * k)
    for at, s, off in _strips(v, w):
        if same:  # equal ids are in one block
            s[ids[at : at + len(s), None] == others[None, :]] = -3
        m = s.shape[1]
        if m > 4 * groups:  # the k-th of the greatest of so many groups is no more than the k-th of all
            some = s[:, : m // groups * groups].reshape(len(s), groups, -1).max(axis=2)
            kth = np.partition(some, groups - k, axis=1)[:, groups - k]
        else:
            kth = np.partition(s, m - k, axis=1)[:, m - k] if m > k else np.full(len(s), -2.0, np.float32)
        from_here = np.where(kth > -2, kth - np.float32(2 * off), np.float32(-2))
        i, j = np.divmod(np.flatnonzero(s >= from_here[:, None]), m)
        i += at
        score = _exact(v, w, i, j)
        order = np.lexsort((others[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        found.append((i[place < k], j[place < k], score[place < k]))
    return tuple(np.concatenate([f[c] for f in found]) if found else np.empty(0, t) for c, t in enumerate((np.int64, np.int64, float)))


def _block_count(n: int, block: int) -> int:
    """So many blocks that each has `block` vectors, or up to 16 times as many where there are more than 16 blocks."""
    return max(1, min(-(-n // block), max(16, -(-n // (16 * block)))))


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows (id, v) once for each pair of blocks x <= y that they take part in."""
    own = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "v")


def _plain_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of vectors that aren't null; single precision stays that."""
    kind = vectors.schema[vec_col].dataType.simpleString()
    return vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind if kind == "array<float>" else "array<double>").alias("v"))


def blocked_pairs(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, least: float | None = None, k: int | None = None, block: int = BLOCK) -> DataFrame:
    """Exact cosine pairs: (a, b, score) with score >= `least`, a < b; or each a's `k` nearest others.

    Vectors are dealt into blocks by hash; a task gets two blocks and multiplies them, so that only what is asked for becomes a row.
    The work is that of all pairs, in bounded tasks; for more vectors than that suits there is an index of `k` candidates to build
    first. Products in single precision name candidates, of which the cosines are taken in double precision. A zero vector is like nothing.
    """
    rows = _plain_rows(vectors, id_col, vec_col)
    dealt = _dealt(rows, _block_count(rows.count(), block))

    def run(table: pa.Table) -> pa.Table:
        ids, block_of = table.column("id").to_numpy(), table.column("block").to_numpy()
        some, v = _units(table)
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        p, q = some[block_of[some] == x], some[block_of[some] == y]
        out = []
        if least is not None:
            for i, j, s in _reaching(v[p], v[q], least):
                a, b = ids[p[i]], ids[q[j]]
                keep = a < b if x == y else np.ones(len(a), bool)
                out.append((np.minimum(a, b)[keep], np.maximum(a, b)[keep], s[keep]))
        else:
            for left, right in [(p, q)] if x == y else [(p, q), (q, p)]:
                i, j, s = _nearest_of(v[left], v[right], ids[left], ids[right], k, x == y)
                out.append((ids[left[i]], ids[right[j]], s))
        a, b, s = (np.concatenate([o[c] for o in out]) if out else [] for c in range(3))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "score": pa.array(s, pa.float64())})

    pairs = dealt.groupBy("x", "y").applyInArrow(run, "a long, b long, score double")
    if k is None:
        return pairs
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k)


def against(queries: DataFrame, vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", *, least: float | None = None, k: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b, score) of each query a and each row b of another id with cosine `least` or more; or of its `k` nearest rows. Exact.

    A task gets a block of queries and one of rows: queries aren't held against each other, nor rows.
    """

    def side(table: DataFrame, asks: bool) -> tuple[DataFrame, int]:
        rows = table.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.lit(asks).alias("asks"))
        return rows, max(1, -(-rows.count() // block))

    (q, n), (r, m) = side(queries, True), side(vectors, False)
    place = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    dealt = q.select(place(n).alias("x"), every(m).alias("y"), "asks", "id", "v").union(r.select(every(n).alias("x"), place(m).alias("y"), "asks", "id", "v"))

    def run(table: pa.Table) -> pa.Table:
        ids, asks = table.column("id").to_numpy(), table.column("asks").to_numpy()
        v = np.array(table.column("v").to_pylist(), float)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
        p, o = np.flatnonzero(asks), np.flatnonzero(~asks)
        score = np.where(ids[p][:, None] == ids[o][None, :], -2.0, np.round(v[p] @ v[o].T, 12))
        if least is not None:
            i, j = np.nonzero(score >= least)
        else:
            tops = [np.lexsort((ids[o], -near))[:k] for near in score]
            i, j = np.repeat(np.arange(len(p)), [len(t) for t in tops]), np.concatenate([*tops, np.empty(0, np.int64)]).astype(np.int64)
            i, j = i[score[i, j] > -2], j[score[i, j] > -2]
        return pa.table({"a": pa.array(ids[p[i]], pa.int64()), "b": pa.array(ids[o[j]], pa.int64()), "score": pa.array(score[i, j], pa.float64())})

    return dealt.groupBy("x", "y").applyInArrow(run, "a long, b long, score double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", *, block: int = BLOCK) -> DataFrame:
    """(a, b, score, rank): each query's `k` nearest rows of another id by cosine, exactly (see `against`)."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return against(queries, vectors, id_col, vec_col, k=k, block=block).withColumn("rank", rank).where(F.col("rank") <= k)


#: Rows that cells are fitted on at most: a bounded sample, of the smallest hashes of ids. Every row is indexed.
SAMPLE = 20_000


def cells(vectors: DataFrame, n: int, id_col: str = "vec_id", vec_col: str = "embedding", *, turns: int = 10, seed: int = 0) -> list[list[float]]:
    """Unit centers of `n` cells at most, by k-means on directions over at most `SAMPLE` rows."""
    chosen = vectors.where(F.col(vec_col).isNotNull()).select(F.xxhash64(F.col(id_col), F.lit(seed)).alias("h"), F.col(vec_col).cast("array<double>").alias("v")).orderBy("h").limit(SAMPLE)
    v = np.array([r.v for r in chosen.collect()], float)
    if not len(v):
        return []
    v = v[np.linalg.norm(v, axis=1) > 0]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    centers = np.unique(v[np.random.default_rng(seed).permutation(len(v))[:n]], axis=0)
    for _ in range(turns):
        own = (v @ centers.T).argmax(axis=1)
        for k in range(len(centers)):
            mean = v[own == k].sum(axis=0)
            if np.linalg.norm(mean) > 0:
                centers[k] = mean / np.linalg.norm(mean)
    return centers.tolist()


def _nearest_cells(rows: DataFrame, centers: list[list[float]], probes: int) -> DataFrame:
    """Rows (id, v) with a row for each of their `probes` nearest cells; v as a unit vector, and none for a zero vector."""
    middle = np.array(centers, float)

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array(batch.column("v").to_pylist(), float)
            size = np.linalg.norm(v, axis=1)
            some = np.flatnonzero(size > 0)
            v = v[some] / size[some, None]
            near = np.argsort(-(v @ middle.T), axis=1, kind="stable")[:, :probes]
            row = np.repeat(np.arange(len(some)), near.shape[1])
            ids = batch.column("id").to_numpy()[some][row]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(near.reshape(-1), pa.int32()), pa.array(list(v[row]), pa.list_(pa.float64()))], names=["id", "cell", "v"])

    return rows.mapInArrow(run, "id long, cell int, v array<double>")


def indexed(vectors: DataFrame, centers: list[list[float]], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The index: (id, cell, v) of every row that has a direction; to be written and kept, with its centers."""
    return _nearest_cells(vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")), centers, 1)


def approximate(queries: DataFrame, index: DataFrame, centers: list[list[float]], k: int, probes: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(a, b, score, rank): each query's `k` nearest rows of another id among those in its `probes` nearest cells.

    More probes find more of the true neighbours and look at more rows; as many as there are cells is exact. Cells meet queries in a join that
    is split where a cell is large.
    """
    asked = queries.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    asked = _nearest_cells(asked, centers, probes).select(F.col("id").alias("a"), "cell", F.col("v").alias("q"))
    met = asked.join(index.select(F.col("id").alias("b"), "cell", "v"), "cell").where("a <> b")
    score = F.round(F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x), 12)
    scored = met.select("a", "b", score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def components(pairs: DataFrame, nodes: DataFrame, id_col: str) -> DataFrame:
    """(id_col, component: the smallest id that links lead to)."""
    from .graph import connected_components

    found = connected_components(pairs.select("a", "b"))
    ids = nodes.select(F.col(id_col).cast("long").alias(id_col))
    return ids.join(found.withColumnRenamed("id", id_col), id_col, "left").select(id_col, F.coalesce("component", id_col).alias("component"))


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links (a, b) links that connect the same: each id with the smallest that it reaches."""
    ids, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = both[: len(a)], both[len(a) :]
    label = np.arange(len(ids))
    while len(a):
        least = np.minimum(label[a], label[b])
        # a group's label is taken down by its links, then each goes to its label's label
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    rest = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[rest]], ids[rest]


def _star_rows(links: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """Links as they come, reduced whenever many are held."""
    a = b = np.empty(0, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for pair in links:
        held.append(pair)
        if sum(len(x) for x, _ in held) > max(CELLS, 2 * len(a)):
            a, b = _stars(np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))
            held = []
    a, b = _stars(np.concatenate([a, *(x for x, _ in held)]), np.concatenate([b, *(y for _, y in held)]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def linked(vectors: DataFrame, least: float, id_col: str = "vec_id", vec_col: str = "embedding", *, block: int = BLOCK) -> DataFrame:
    """(vec_id, component): the smallest id that links of cosine `least` or more lead to, over any number of vectors. Exact.

    No table holds all links: a task gives for its vectors links that connect the same. First each block is held against the next one. What that
    connects needn't be compared any more: all vectors but those of the largest component so far are then held against all others; if those are more
    than half, all pairs of blocks are compared.
    """
    from ..shared import forget, materialized

    rows = materialized(_plain_rows(vectors, id_col, vec_col), "vectors")
    n = rows.count()
    blocks = _block_count(n, block)
    place = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")

    def between(table: pa.Table) -> pa.Table:
        ids, block_of = table.column("id").to_numpy(), table.column("block").to_numpy()
        some, v = _units(table)
        p, q = (some[block_of[some] == table.column(c)[0].as_py()] for c in "xy")
        return _star_rows((ids[p[i]], ids[q[j]]) for i, j, _ in _reaching(v[p], v[q], least))

    def across(table: pa.Table) -> pa.Table:
        ids, asks = table.column("id").to_numpy(), table.column("asks").to_numpy()
        some, v = _units(table)
        p, q = some[asks[some]], some[~asks[some]]
        return _star_rows((ids[p[i]], ids[q[j]]) for i, j, _ in _reaching(v[p], v[q], least))

    chain = rows.withColumn("x", place).unionByName(rows.withColumn("x", F.pmod(place - 1, F.lit(blocks)))) if blocks > 1 else rows.withColumn("x", place)
    chain = chain.select("x", F.pmod(F.col("x") + 1, F.lit(blocks)).alias("y"), place.alias("block"), "id", "v")
    links = materialized(chain.groupBy("x", "y").applyInArrow(between, "a long, b long"), "links")
    if blocks > 1:
        first = materialized(components(links, rows, "id"), "components")
        largest = first.groupBy("component").count().orderBy(F.desc("count"), "component").first()
        odd = materialized(rows.join(first.where(F.col("component") != largest["component"]), "id", "left_semi"), "odd")
        m = odd.count()
        if 2 * m > n:
            more = _dealt(rows, blocks).groupBy("x", "y").applyInArrow(between, "a long, b long")
        else:
            parts = max(1, -(-m // (16 * block)))
            asked = odd.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("y"), F.lit(True).alias("asks"), "id", "v")
            others = rows.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("x"), place.alias("y"), F.lit(False).alias("asks"), "id", "v")
            more = asked.union(others).groupBy("x", "y").applyInArrow(across, "a long, b long")
        links = links.unionByName(materialized(more, "links"))
        forget(odd)
    found = components(links, vectors.select(F.col(id_col).cast("long").alias(id_col)), id_col)
    forget(rows)
    return found


def star_clusters(vectors: DataFrame, least: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, center): greedy star clusters. The smallest free id takes all free ones within reach, then the next.

    Rounds settle many centers at once: a free vector that has no smaller free neighbour is one.
    """
    from .graph import materialized

    pairs = materialized(blocked_pairs(vectors, id_col, vec_col, least=least).select("a", "b"))
    free = materialized(vectors.select(F.col(id_col).cast("long").alias("id")))
    done = None
    while not free.isEmpty():
        live = pairs.join(free.withColumnRenamed("id", "a"), "a").join(free.withColumnRenamed("id", "b"), "b")
        centers = free.join(live.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        taken = live.join(centers.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("center"))
        new = materialized(taken.unionByName(centers.select("id", F.col("id").alias("center"))))
        done = new if done is None else done.unionByName(new)
        free = materialized(free.join(new.select("id"), "id", "left_anti"))
    if done is None:
        return vectors.select(F.col(id_col), F.col(id_col).alias("center")).limit(0)
    return done.withColumnRenamed("id", id_col)


def centroids(members: DataFrame, by: str, vec_col: str = "embedding") -> DataFrame:
    """(by, n, centroid): the mean vector of each group, position by position."""
    parts = members.select(by, F.posexplode(vec_col).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    return parts.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("centroid"))


def medoids(members: DataFrame, by: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(by, medoid): the member with the least sum of cosine distances to its group; ties go to the smallest id.

    The sum over a group of 1 - cosine is n minus the dot product with the sum of the group's unit vectors: no pairs are made.
    """
    from .search import dot, norm

    unit = F.when(norm(F.col(vec_col)) > 0, F.transform(F.col(vec_col), lambda x: x.cast("double") / norm(F.col(vec_col)))).otherwise(F.transform(F.col(vec_col), lambda x: F.lit(0.0)))
    rows = members.select(by, id_col, unit.alias("u"))
    total = centroids(rows, by, "u").select(by, "n", F.transform("centroid", lambda x: x * F.col("n")).alias("s"))
    scored = rows.join(total, by).withColumn("cost", F.round(F.col("n") - dot(F.col("u"), F.col("s")), 9))
    return scored.groupBy(by).agg(F.min_by(id_col, F.struct("cost", id_col)).alias("medoid"))


def drift(steps: DataFrame, by: str, order: str, vec_col: str, threshold: float = 0.5, last: int = 10) -> DataFrame:
    """(by, cusum, drifted): how far a cluster's centroid has come over its last `last` positions, and whether that is too far."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    recent = steps.withColumn("__tm_p", F.row_number().over(w)).where(F.col("__tm_p") <= last)
    step = distance(F.col(vec_col), F.lag(vec_col).over(Window.partitionBy(by).orderBy(order)))
    moved = recent.withColumn("__tm_d", F.coalesce(step, F.lit(0.0)))
    return moved.groupBy(by).agg(F.sum("__tm_d").alias("cusum")).withColumn("drifted", F.col("cusum") > threshold)


def near_existing(new: DataFrame, old: DataFrame, least: float, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, duplicate_of): the smallest stored id within reach of each new vector; null if there is none."""
    found = against(new, old, id_col, vec_col, least=least).groupBy(F.col("a").alias(id_col)).agg(F.min("b").alias("duplicate_of"))
    return new.select(id_col).join(found, id_col, "left")


def online_clusters(episodes: DataFrame, id_col: str, ts: str, vec_col: str, by: str, least: float = 0.8) -> DataFrame:
    """(id_col, by, cluster): in order of time each episode joins the cluster whose running mean is nearest, if near enough, or begins one.

    The order decides, so a group is one task's; its state is a mean vector a cluster.
    """
    import pandas as pd

    kind, key = (episodes.schema[c].dataType.simpleString() for c in (id_col, by))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([ts, id_col], ignore_index=True)
        sums: list[np.ndarray] = []
        sizes: list[int] = []
        out = []
        for v in g[vec_col]:
            v = np.asarray(v, float)
            means = np.array([s / n for s, n in zip(sums, sizes, strict=True)]).reshape(len(sums), len(v))
            norms = np.linalg.norm(means, axis=1) * np.linalg.norm(v) if len(sums) else np.empty(0)
            near = np.divide(means @ v, norms, out=np.zeros(len(sums)), where=norms > 0) if len(sums) else norms
            k = int(near.argmax()) if len(near) and near.max() >= least else len(sums)
            if k == len(sums):
                sums.append(np.zeros_like(v))
                sizes.append(0)
            sums[k], sizes[k] = sums[k] + v, sizes[k] + 1
            out.append(k)
        return pd.DataFrame({id_col: g[id_col], by: g[by], "cluster": out})

    return episodes.groupBy(by).applyInPandas(run, f"{id_col} {kind}, {by} {key}, cluster int")


def sized_clusters(members: DataFrame, cluster: str, least: int = 2, most: int = 50) -> DataFrame:
    """Members of clusters of a size within bounds."""
    sizes = members.groupBy(cluster).agg(F.count("*").alias("__tm_n")).where(F.col("__tm_n").between(least, most))
    return members.join(sizes.select(cluster), cluster, "left_semi")


def kmeans(rows: DataFrame, id_col: str, features: Column, k: int | None = None, turns: int = 100, seed: int = 0) -> DataFrame:
    """(id_col, cluster) by k-means of features (arrays of numbers), k-means|| first; the root of the number of rows unless k is given.

    Rows with a null feature have no cluster. Fewer rows than k make fewer clusters; no rows, none.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = features.cast("array<double>")
    whole = v.isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull()), F.lit(True))
    known = rows.select(id_col, v.alias("v")).where(whole.isNotNull() & whole).select(id_col, array_to_vector("v").alias("features"))
    n = known.count()
    if not n:
        return rows.select(id_col, F.lit(None).cast("int").alias("cluster"))
    model = KMeans(k=max(2, min(n, round(n**0.5) if k is None else k)), seed=seed, maxIter=turns, initMode="k-means||").fit(known) if n > 1 else None
    found = known.select(id_col, F.lit(0).alias("cluster")) if model is None else model.transform(known).select(id_col, F.col("prediction").alias("cluster"))
    return rows.select(id_col).join(found, id_col, "left")


#: Members of a cluster that a task can hold.
TASK = 20_000


def _dealt_out(rows: DataFrame, parts: int = 16) -> DataFrame:
    """Rows (id, c, v) with clusters c dealt out until none has more than TASK rows."""
    from ..shared import materialized

    while True:
        big = materialized(rows.where("c is not null").groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > TASK).select("c"), "big")
        if big.isEmpty():
            return rows
        of_big = rows.join(big, "c", "left_semi")
        place = F.row_number().over(Window.partitionBy("c").orderBy(F.xxhash64("id"), "id"))
        centers = of_big.withColumn("k", place).where(F.col("k") <= parts).groupBy("c").agg(F.collect_list(F.struct("k", F.col("v").alias("w"))).alias("w"))
        far = lambda x: F.aggregate(F.zip_with("v", x["w"], lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda t, e: t + e)
        near = F.array_min(F.transform("w", lambda x: F.struct(far(x).alias("d"), x["k"].alias("k"))))["k"]
        dealt = materialized(of_big.join(centers, "c").select("id", "c", "v", near.alias("k")), "dealt")
        alike = dealt.groupBy("c").agg((F.count_distinct("k") == 1).alias("alike"))
        part = F.when(F.col("alike"), F.pmod(F.xxhash64("id", F.length("c")), F.lit(parts))).otherwise(F.col("k"))
        new = dealt.join(alike, "c").select("id", F.concat_ws("/", "c", part.cast("string")).alias("c"), "v")
        rows = materialized(rows.join(big, "c", "left_anti").unionByName(new), "parts")


def _nearest_center(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """By squared distance, the first of equals: products first, and differences where those leave less than their rounding between two."""
    near, each = np.empty(len(x), np.int64), (centers * centers).sum(axis=1)
    step = max(1, CELLS // len(centers))
    for at in range(0, len(x), step):
        some = x[at : at + step]
        far = each[None, :] - 2 * (some @ centers.T)
        near[at : at + step] = own = far.argmin(axis=1)
        slack = 1e-12 * ((some * some).sum(axis=1) + each.max())
        for i in np.flatnonzero((far <= far[np.arange(len(some)), own][:, None] + slack[:, None]).sum(axis=1) > 1):
            near[at + i] = ((some[i] - centers) ** 2).sum(axis=1).argmin()
    return near


def resized(members: DataFrame, cluster: str, id_col: str = "vec_id", vec_col: str = "embedding", least: int = 2, most: int = 50, seed: int = 0) -> DataFrame:
    """(id_col, cluster: its smallest member): clusters of `least` to `most` members; smaller ones are noise (null), larger ones are split in turn.

    A cluster of more than `TASK` members is dealt in rounds to the nearest of sixteen of them (equal vectors by the hash of their ids), until
    a task can hold each part. Then it is split into as many parts as it needs, by k-means in a task of its own, and its parts are looked at
    again; equal vectors that stay together are cut by id. What a split leaves below `least` is noise.
    """

    def split(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        order = np.argsort(ids)
        lists = table.column("v").combine_chunks()
        ids, v = ids[order], lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)[order]
        rng = np.random.default_rng(seed)
        todo, label = [np.arange(len(ids))], np.full(len(ids), -1)
        while todo:
            some = todo.pop()
            if len(some) <= most:
                if len(some) >= least:
                    label[some] = some[0]
                continue
            k = -(-len(some) // most)
            distinct = np.unique(v[some], axis=0)
            if len(distinct) < 2:
                todo += np.array_split(some, k)
                continue
            centers = distinct[np.sort(rng.permutation(len(distinct))[: max(2, k)])]
            x, before = v[some], None
            for _ in range(25):
                near = _nearest_center(x, centers)
                if before is not None and (near == before).all():
                    break  # centers stay where they are from here on
                before, order, ends = near, np.argsort(near, kind="stable"), np.cumsum(np.bincount(near, minlength=len(centers)))
                centers = np.array([x[order[i:j]].mean(axis=0) if i < j else centers[c] for c, (i, j) in enumerate(zip(np.r_[0, ends[:-1]], ends, strict=True))])
            parts = [some[near == c] for c in range(len(centers)) if (near == c).any()]
            todo += parts if len(parts) > 1 else np.array_split(some, k)
        return pa.table({"id": pa.array(ids, pa.int64()), "cluster": pa.array(ids[np.maximum(label, 0)], pa.int64(), mask=label < 0)})

    rows = members.select(F.col(id_col).cast("long").alias("id"), F.col(cluster).cast("string").alias("c"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = _dealt_out(rows)
    sizes = rows.where("c is not null").groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    known = rows.join(sizes, "c", "left")
    right = known.where(F.col("n").between(least, most)).select("id", F.col("first").alias("cluster"))
    small = known.where(F.coalesce(F.col("n") < least, F.lit(True))).select("id", F.lit(None).cast("long").alias("cluster"))
    large = known.where(F.col("n") > most).groupBy("c").applyInArrow(split, "id long, cluster long")
    return right.unionByName(small).unionByName(large).withColumnRenamed("id", id_col)
