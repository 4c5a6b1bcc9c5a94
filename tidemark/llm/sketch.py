"""Count-min tables that tasks fill by themselves and Spark adds up: which keys can't have reached a count.

`Counts` is a whole table of bounded size in each task: good for as many different keys as it has slots. `Tally` keeps only the slots that a
task has seen, of a table so large that it needn't fit a task: ranges of it are added up by tasks of their own.

A table has `rows` rows of 2**bits slots of one byte, which stop at 255. Sums of stopped counts are stopped sums, so that a key's least
slot is never below the smaller of its count and 255. What is broadcast is a bit for each slot: whether it has reached the least count
that is asked for. Hash collisions and full tables let more keys pass; they never stop one that should.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize
from .runs import salted
from .text import release

FULL = 255
#: Slots that are merged, and sent, as one row.
BLOCK = 4096
SCHEMA = "slots int, counts binary"
#: Bits of the slots of a `Tally` that one task adds up at once (a byte each), and slots that a task holds before they leave it.
RANGE_BITS, HELD = 24, 3_000_000
#: Bits that are broadcast for each slot that has reached the least count, and the least and most of them (powers of two).
SPARE, LEAST_BITS, MOST_BITS = 32, 22, 28


def places(row: int, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Each hash's slot in a row."""
    return (salted(hashes, row) >> np.uint64(64 - bits)).astype(np.int64)


class Counts:
    """One task's table."""

    def __init__(self, rows: int, bits: int) -> None:
        self.bits, self.table = bits, np.zeros((rows, 1 << bits), np.uint8)

    def add(self, row: int, hashes: np.ndarray, n: np.ndarray | None = None) -> None:
        """Counts each hash n times (once if n isn't given)."""
        slots = places(row, hashes, self.bits)
        if n is None:
            slots, n = np.unique(slots, return_counts=True)
        else:
            slots, back = np.unique(slots, return_inverse=True)
            n = np.bincount(back, n, len(slots)).astype(np.int64)
        self.table[row, slots] = np.minimum(self.table[row, slots] + n, FULL)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """(the block's number over all rows, its counts) of those that have any."""
        held = self.table.reshape(-1, BLOCK)
        for k in np.flatnonzero(held.any(axis=1)).tolist():
            yield k, held[k].tobytes()


def _merge(least: int):  # noqa: ANN202
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = np.frombuffer(counts.as_buffer(), np.uint8)
                held[k] = np.minimum(held[k].astype(np.uint16) + new, FULL).astype(np.uint8) if k in held else new.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(v >= least).tobytes() for v in held.values()], pa.binary())], names=["slots", "counts"])

    return run


class Reached:
    """For each slot a bit: whether it has reached the least count. In tasks, use it through `passes`."""

    def __init__(self, rows: int, bits: int) -> None:
        self.bits, self.table = bits, np.zeros((rows << bits) // 8, np.uint8)

    def passes(self, row: int, hashes: np.ndarray) -> np.ndarray:
        slot = places(row, hashes, self.bits) + (row << self.bits)
        return (self.table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


def merged(counts: DataFrame, rows: int, bits: int, least: int) -> Broadcast:
    """The broadcast bits (`Reached`) of tasks' blocks (slots, counts): rows * 2**bits / 8 bytes, whatever the input.

    Blocks are dealt by number, each task adds up its own as they come, and only bits reach the driver.
    """
    if not 0 < least <= FULL or bits < 12:
        raise ValueError("a table tells counts up to 255 apart and has 4096 slots or more")
    spark = counts.sparkSession
    found = Reached(rows, bits)
    dealt = counts.repartition(min(64, rows << (bits - 12)), F.col("slots"))
    for r in dealt.mapInArrow(_merge(least), SCHEMA).collect():
        found.table[r.slots * (BLOCK // 8) : (r.slots + 1) * (BLOCK // 8)] = np.frombuffer(r.counts, np.uint8)
    return spark.sparkContext.broadcast(found)


def planes(x: np.ndarray, width: int) -> bytes:
    """The lowest `width` bytes of numbers of 64 bits: all first bytes, then all second ones (which packs well)."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def numbers(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(width, -1).T
    return out.reshape(-1).view(np.uint64)


class Tally:
    """The slots that a task has seen, of `rows` rows of 2**bits slots: as much memory as there are keys, and `HELD` at most."""

    def __init__(self, rows: int, bits: int) -> None:
        self.bits, self.held, self.size = bits, [[] for _ in range(rows)], 0

    def add(self, row: int, hashes: np.ndarray) -> None:
        slots, n = np.unique(places(row, hashes, self.bits).astype(np.uint32), return_counts=True)
        self.held[row].append(slots.astype(np.uint64) << np.uint64(8) | np.minimum(n, FULL).astype(np.uint64))
        self.size += len(slots)

    def _settle(self) -> None:
        """Equal slots as one."""
        for row, parts in enumerate(self.held):
            if len(parts) > 1:
                every = np.sort(np.concatenate(parts))
                slots = every >> np.uint64(8)
                first = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])))
                n = np.add.reduceat(every & np.uint64(FULL), first) if len(every) else every
                self.held[row] = [slots[first] << np.uint64(8) | np.minimum(n, np.uint64(FULL))]
        self.size = sum(len(x) for parts in self.held for x in parts)

    def blocks(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        """When too many are held, or at the end: (the range's number over all rows, its slots as differences, and counts)."""
        if self.size > HELD or last:
            self._settle()
        if self.size > HELD // 2 or last:
            inner = min(RANGE_BITS, self.bits)
            out: list[tuple[int, bytes]] = []
            for row, parts in enumerate(self.held):
                for every in parts:
                    cuts = np.searchsorted(every >> np.uint64(8 + inner), np.arange((1 << (self.bits - inner)) + 1, dtype=np.uint64)).tolist()
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        if a < b:
                            low = (every[a:b] >> np.uint64(8)) & np.uint64((1 << inner) - 1)
                            out.append(((row << (self.bits - inner)) + k, planes(np.diff(low, prepend=np.uint64(0)), 3) + planes(every[a:b], 1)))
                parts.clear()
            self.size = 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([v for _, v in out], pa.binary())], names=["slots", "counts"])


def _reached(least: int, inner: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over blocks in order of their range: how many slots of a range have reached the least count, and which."""

    def found(now: int, table: np.ndarray) -> pa.RecordBatch:
        slots = np.flatnonzero(table >= least).astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([len(slots)], pa.int64()), pa.array([slots.tobytes()], pa.binary())], names=["slots", "n", "which"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = -1, np.zeros(1 << inner, np.uint8)
        for batch in batches:
            for k, counts in zip(batch.column("slots").to_pylist(), batch.column("counts"), strict=True):
                if k != now:
                    if now >= 0:
                        yield found(now, table)
                        table[:] = 0
                    now = k
                data = np.frombuffer(counts.as_buffer(), np.uint8)
                n = len(data) // 4
                slots = np.cumsum(numbers(data[: 3 * n], 3)).astype(np.int64)
                table[slots] = np.minimum(table[slots].astype(np.uint16) + data[3 * n :], FULL)
        if now >= 0:
            yield found(now, table)
        del table
        release()

    return run


def _as_bits(inner: int, kept: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A range's slots as bits, of which as many slots share one as it takes to have 2**kept of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for which in batch.column("which"):
                bits = np.zeros(1 << kept, bool)
                bits[np.frombuffer(which.as_buffer(), np.uint32) >> np.uint32(inner - kept)] = True
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("slots"), pa.array(out, pa.binary())], names=["slots", "counts"])

    return run


def tallied(counts: DataFrame, rows: int, bits: int, least: int) -> Broadcast:
    """The broadcast bits (`Reached`) of tasks' tallies.

    A task adds up one range at a time, in 2**RANGE_BITS bytes. What is broadcast has `SPARE` bits for each slot of the fullest row that has
    reached the least count, 2**MOST_BITS bits a row at most: it grows with what is frequent, not with what there is.
    """
    if not 0 < least <= FULL or not 12 <= bits <= 32:
        raise ValueError("a table tells counts up to 255 apart and has 4096 slots or more")
    spark = counts.sparkSession
    inner = min(RANGE_BITS, bits)
    outer = bits - inner
    dealt = counts.repartition("slots").sortWithinPartitions("slots")
    reached = materialize(dealt.mapInArrow(_reached(least, inner), "slots int, n long, which binary"), "reached")
    most = max((r.n for r in reached.groupBy(F.shiftright("slots", outer).alias("row")).agg(F.sum("n").alias("n")).collect()), default=0)
    kept = min(max(math.ceil(math.log2(max(1, SPARE * most))), LEAST_BITS), MOST_BITS, bits)
    found = Reached(rows, kept)
    size = (1 << (kept - outer)) // 8
    for r in reached.where("n > 0").mapInArrow(_as_bits(inner, kept - outer), SCHEMA).toLocalIterator():
        found.table[r.slots * size : (r.slots + 1) * size] = np.frombuffer(r.counts, np.uint8)
    return spark.sparkContext.broadcast(found)
