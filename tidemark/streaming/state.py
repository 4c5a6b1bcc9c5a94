"""Streams with state of their own: clusters that grow, window totals that late rows revise, a cap over all keys, a buffer that expires.

Processors keep their state in RocksDB (`with_state` names the provider), so that it needn't fit in memory and outlives a restart. What
decides is event time and the order of rows, never the clock: rows of a batch are taken in order of (ts, id).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> SparkSession:
    """The same session; streams that start from now on can have processors."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    some = [r for r in rows if len(r)]
    return pd.concat(some).sort_values(list(by), ignore_index=True) if some else pd.DataFrame(columns=list(by))


# -- clusters that grow


class ClusterFold:
    """The clusters of one shard, vector by vector.

    A vector that is within `same` (cosine) of one that was kept is a duplicate of the first such. Others join the cluster whose centroid is
    nearest, within `near`, or begin one. A cluster remembers its last ten centroids; where their steps add up to more than `drift`, the
    newcomer that moved it begins a cluster of its own. Beyond `most` rows of a source its rows are archived. Vectors without a length
    are skipped, but counted.
    """

    def __init__(self, same: float = 0.92, near: float = 0.75, drift: float = 0.5, most: int = 100) -> None:
        self.same, self.near, self.drift, self.most = same, near, drift, most
        self.ids: list = []
        self.units: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.last: list[list[np.ndarray]] = []
        self.seen: dict = {}

    def add(self, key: object, source: object, vector: list[float] | None) -> tuple[str, int | None, object]:
        """(what became of it, its cluster, what it is a duplicate of)."""
        self.seen[source] = self.seen.get(source, 0) + 1
        v = np.asarray([] if vector is None else vector, float)
        size = float(np.linalg.norm(v)) if len(v) else 0.0
        if not size >= 1e-6:
            return "skipped", None, None
        unit = v / size
        if self.units:
            like = np.flatnonzero(np.round(np.array(self.units) @ unit, 12) >= self.same)
            if len(like):
                return "duplicate", None, self.ids[like[0]]
        self.ids.append(key)
        self.units.append(unit)
        best, place = self.near, None
        if self.sums:
            middle = np.array(self.sums)
            norms = np.linalg.norm(middle, axis=1)
            score = np.round(np.divide(middle @ unit, norms, out=np.full(len(norms), -2.0), where=norms > 0), 12)
            k = int(score.argmax())
            place = k if score[k] >= best else None
        if place is None:
            return "new", self._begin(v), None
        self.sums[place] = self.sums[place] + v
        self.sizes[place] += 1
        self.last[place] = [*self.last[place], self.sums[place] / self.sizes[place]][-10:]
        if sum(float(np.linalg.norm(b - a)) for a, b in zip(self.last[place], self.last[place][1:], strict=False)) > self.drift:
            self.sums[place] = self.sums[place] - v
            self.sizes[place] -= 1
            self.last[place][-1] = self.sums[place] / self.sizes[place]
            return "split", self._begin(v), None
        return "attached", place, None

    def _begin(self, v: np.ndarray) -> int:
        self.sums.append(v.copy())
        self.sizes.append(1)
        self.last.append([v.copy()])
        return len(self.sums) - 1

    def archived(self, source: object) -> bool:
        return self.seen.get(source, 0) > self.most


class _Clusters(StatefulProcessor):
    def __init__(self, make: Callable[[], ClusterFold], shard: str) -> None:
        self.make, self.shard = make, shard

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("clusters", "fold binary")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803  (Spark's names)
        fold = pickle.loads(bytes(self.held.get()[0])) if self.held.exists() else self.make()  # noqa: S301  (its own state)
        out = []
        for r in _in_order(rows, "ts", "id").itertuples(index=False):
            what, cluster, copy = fold.add(r.id, r.source, r.embedding)
            out.append((key[0], r.id, what, cluster, copy, fold.archived(r.source)))
        self.held.update((pickle.dumps(fold),))
        found = pd.DataFrame(out, columns=[self.shard, "id", "action", "cluster", "duplicate_of", "archived"])
        yield found.astype({"cluster": "Int32", "duplicate_of": "Int64"})

    def close(self) -> None:
        pass


def cluster_ingest(vectors: DataFrame, shard: str, same: float = 0.92, near: float = 0.75, drift: float = 0.5, most: int = 100) -> DataFrame:
    """(shard, id, action, cluster, duplicate_of, archived) of a stream (shard, id, ts, source, embedding), see `ClusterFold`.

    A shard's clusters and the directions of what it has kept are one value of its state: choose shards (a chat, a cell) of
    thousands of vectors. The rows of a shard must come in order of time from batch to batch; then it doesn't matter how they are cut.
    """
    kind = vectors.schema[shard].dataType.simpleString()
    rows = vectors.select(shard, F.col("id").cast("long").alias("id"), "ts", F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("source"), F.col("embedding").cast("array<double>").alias("embedding"))
    make = lambda: ClusterFold(same, near, drift, most)
    return rows.groupBy(shard).transformWithStateInPandas(_Clusters(make, shard), f"{shard} {kind}, id long, action string, cluster int, duplicate_of long, archived boolean", "append", "none")


# -- totals that late rows revise


class WindowTotals:
    """Totals by keys and window in a folder, revised by every row however late it comes.

    A batch of a stream adds a table of its changes under its number; the same batch again replaces it, so that each counts once.
    `compact` sums them up into one table; batches that it holds are taken, and change nothing if they come again.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], ts: str, size: str, value: str) -> None:
        self.spark, self.folder, self.keys, self.ts, self.size, self.value = spark, folder.rstrip("/"), keys, ts, size, value

    def _names(self, what: str) -> list[int]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{what}")
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        whole = lambda p: fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{p.toString()}/_SUCCESS"))
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(at) if whole(x.getPath()))

    def changes(self, batch: DataFrame) -> DataFrame:
        w = F.window(self.ts, self.size)
        v = F.col(self.value).cast("double")
        sums = batch.where(F.col(self.ts).isNotNull()).groupBy(*self.keys, w["start"].alias("start")).agg(F.count("*").alias("n"), F.count(v).alias("values"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"))
        return sums.withColumn("revisions", F.lit(1).cast("long"))

    def write(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        if number > max(self._names("sums"), default=-1):
            self.changes(batch).write.mode("overwrite").parquet(f"{self.folder}/changes/{number}")

    def _sum(self) -> tuple[DataFrame | None, int]:
        sums = self._names("sums")
        upto = sums[-1] if sums else -1
        later = [k for k in self._names("changes") if k > upto]
        paths = [f"{self.folder}/sums/{upto}"] * bool(sums) + [f"{self.folder}/changes/{k}" for k in later]
        if not paths:
            return None, upto
        adds = [F.sum(c).alias(c) for c in ("n", "values", "total")] + [F.min("least").alias("least"), F.max("most").alias("most"), F.sum("revisions").alias("revisions")]
        return self.spark.read.parquet(*paths).groupBy(*self.keys, "start").agg(*adds), max([upto, *later])

    def compact(self) -> int:
        """Sums all changes up; the number of the last batch that is held, -1 for none."""
        rows, upto = self._sum()
        if rows is not None and upto not in self._names("sums"):
            rows.write.mode("overwrite").parquet(f"{self.folder}/sums/{upto}")
        return upto

    def totals(self) -> DataFrame | None:
        """(keys, start, n, values, total, mean, least, most, revisions: batches that changed it); None before the first batch."""
        rows, _ = self._sum()
        return None if rows is None else rows.withColumn("mean", F.col("total") / F.col("values"))


# -- a cap over all keys


class _Cap(StatefulProcessor):
    """Waits until no earlier row can come; then rows are taken in order. State: rows that wait, and the last `most` times let through."""

    def __init__(self, columns: list[str], most: int, micros: int, late: int) -> None:
        self.columns, self.most, self.micros, self.late = columns, most, micros, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "waiting binary, passed binary")

    def _let(self, new: list[tuple], upto: int) -> pd.DataFrame:
        waiting, passed = (pickle.loads(bytes(x)) for x in self.held.get()) if self.held.exists() else ([], [])  # noqa: S301  (its own state)
        waiting = sorted([*waiting, *new])
        out, at = [], 0
        while at < len(waiting) and waiting[at][0] < upto:
            t = waiting[at][0]
            passed = [x for x in passed if t - x <= self.micros]
            if len(passed) < self.most:
                passed.append(t)
                out.append(waiting[at][2])
            at += 1
        self.held.update((pickle.dumps(waiting[at:]), pickle.dumps(passed)))
        if waiting[at:]:  # the watermark that this batch makes, or else the one that passes the last row
            last = waiting[-1][0]
            self.handle.registerTimer(((last - self.late) if upto <= last - self.late else last) // 1000 + 1)
        return pd.DataFrame(out, columns=self.columns)

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        some = _in_order(rows, "ts", "id")
        new = [(r.ts.value // 1000, int(r.id), tuple(getattr(r, c) for c in self.columns)) for r in some.itertuples(index=False)]
        yield self._let(new, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: ANN001, ANN201, N802, N803
        yield self._let([], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def rate_capped(hits: DataFrame, most: int = 12, seconds: int = 900, late: str = "1 minute", by: str | None = None) -> DataFrame:
    """Of a stream of hits (id, ts, ..) those that are let through: at most `most` in any `seconds`, over all of it or a `by`.

    Rows wait until the watermark has passed them and are then taken in order of (ts, id), however they came; rows later than `late` are
    dropped. A time just `seconds` ago still counts. One key sees all hits: put `streams.cooldown` before it, written to a table of its own, which leaves one hit
    a symbol and cooldown. Ids of equal times must differ.
    """
    columns = hits.columns
    rows = hits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = rows.withColumn("__tm_one", F.lit(0)).groupBy("__tm_one") if by is None else rows.groupBy(by)
    schema = ", ".join(f"`{f.name}` {'timestamp' if f.name == 'ts' else f.dataType.simpleString()}" for f in hits.schema)
    return grouped.transformWithStateInPandas(_Cap(columns, most, seconds * 1_000_000, int(pd.Timedelta(late).total_seconds() * 1_000_000)), schema, "append", "eventtime")


# -- a buffer that expires


class _Buffer(StatefulProcessor):
    def __init__(self, by: str, micros: int, most: int) -> None:
        self.by, self.micros, self.most = by, micros, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "rows binary, newest long, flushes long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: ANN001, ANN201, N802, N803
        blob, newest, flushes = self.held.get() if self.held.exists() else (None, None, 0)
        held = pickle.loads(bytes(blob)) if blob is not None else {}  # noqa: S301  (its own state)
        out = []
        for r in _in_order(rows, "ts", "id").itertuples(index=False):
            at, place = r.ts.value // 1000, int(r.id)
            if newest is not None and at <= newest - self.micros:
                out.append((key[0], place, at, r.payload, "late", None))
                continue
            held[at, place] = r.payload
            newest = at if newest is None else max(newest, at)
            if len(held) > self.most:
                flushes += 1
                for (t, k), payload in sorted(held.items()):
                    gone = t <= newest - self.micros
                    out.append((key[0], k, t, payload, "expired" if gone else "flushed", None if gone else flushes))
                held = {}
        for t, k in sorted(held):  # what has expired meanwhile leaves at the end of a batch
            if t > newest - self.micros:
                break
            out.append((key[0], k, t, held.pop((t, k)), "expired", None))
        if newest is not None:
            self.held.update((pickle.dumps(held), newest, flushes))
        found = pd.DataFrame(out, columns=[self.by, "id", "at", "payload", "fate", "flush"]).astype({"flush": "Int64"})
        found["ts"] = pd.to_datetime(found.pop("at"), unit="us", utc=True)
        yield found[[self.by, "id", "ts", "payload", "fate", "flush"]]

    def close(self) -> None:
        pass


def ttl_buffer(events: DataFrame, by: str, days: float = 7, most: int = 1000) -> DataFrame:
    """(by, id, ts, payload, fate, flush) of a stream (by, id, ts, payload): each row once, when it leaves its key's buffer.

    A row that is `days` or more older than the newest of its key is late, and isn't kept; one that becomes so in the buffer has expired;
    when the buffer has more than `most`, all that is left of it is flushed, in order. A row again, of equal id and time, replaces the one
    in the buffer. What is still in it stays in the state.
    """
    kind = events.schema[by].dataType.simpleString()
    rows = events.select(by, F.col("id").cast("long").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("payload").cast("string").alias("payload"))
    return rows.groupBy(by).transformWithStateInPandas(_Buffer(by, int(days * 86_400_000_000), most), f"{by} {kind}, id long, ts timestamp, payload string, fate string, flush long", "append", "none")
