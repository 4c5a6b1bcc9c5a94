"""MinHash near-duplicate groups: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

Each text's distinct word shingles are hashed once and dealt into bins; a bin keeps its least hash, and an empty bin borrows
from a full one that a hash of the bin's number and the attempt names (Shrivastava, "Optimal densification for fast and accurate
minwise hashing", 2017). Bands of consecutive bins are the bucket keys. Documents with equal shingle sets are one item. Inside a
bucket only star edges to its smallest member are candidates at first; see `groups_by_shared_keys` for how nothing is lost by it.
Four bits of each bin give a cheap estimate that drops hopeless pairs (six standard deviations below the threshold), and every
remaining link is confirmed on full shingle sets.

With 32 bands of 4 bins a pair at similarity 0.8 shares no bucket with a probability of (1 - 0.8**4)**32, or 5e-8.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import asked_for, forget, forget_made, made, materialize, release_shuffles, settled
from .components import groups_by_shared_keys
from .text import chunks, mix, shingle_hashes, word_hashes

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """A row of `bins` hashes for each sorted set of hashes; a row of zeros for an empty set."""
    edges = (np.arange(bins + 1, dtype=np.float64) * 2.0**32 / bins).astype(np.uint64) << np.uint64(32)
    out, full = np.zeros((len(sets), bins), np.uint64), np.zeros((len(sets), bins), bool)
    for k, h in enumerate(sets):
        if len(h):
            at = np.searchsorted(h, edges[:-1])
            stop = np.append(at[1:], len(h))
            full[k] = at < stop
            out[k, full[k]] = h[at[full[k]]]
    rows, holes = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        with np.errstate(over="ignore"):
            probe = mix(holes.astype(np.uint64) * _GOLDEN + np.uint64(attempt)) % np.uint64(bins)
        hit = full[rows, probe]
        out[rows[hit], holes[hit]] = out[rows[hit], probe[hit]]
        rows, holes = rows[~hit], holes[~hit]
    return out


def _sketcher(shingle: int, bands: int, rows: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            sets = shingle_hashes(*word_hashes(batch.column("text")), shingle)
            table = signatures(sets, bands * rows)
            with np.errstate(over="ignore"):
                keys = np.zeros((len(sets), bands), np.uint64)
                for r in range(rows):
                    keys = mix(keys * _GOLDEN + table[:, r::rows] + np.uint64(r))
                keys = mix(keys + np.arange(bands, dtype=np.uint64) * _GOLDEN)
            nibbles = (mix(table) & np.uint64(15)).reshape(len(sets), -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
            marks = np.bitwise_or.reduce(nibbles, axis=2)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([len(h) for h in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()), lists(keys), lists(marks)],
                names=["id", "n", "digest", "bands", "marks"],
            )

    return run


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """(id, n: set size, digest: of the whole set, bands: bucket keys, marks: four bits of each bin)."""
    if bands * rows % 16:
        raise ValueError("bands * rows must be a multiple of 16")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        _sketcher(shingle, bands, rows), "id long, n long, digest binary, bands array<long>, marks array<long>"
    )


def _most_apart(percent: int, bins: int) -> int:
    """In how many bins a pair at the threshold may differ: six standard deviations above the mean."""
    share = percent / 100
    return math.ceil(bins * (1 - share) + 6 * math.sqrt(bins * share * (1 - share)) + 1)


def _may_match(percent: int, bins: int) -> Callable[[str, str], Column]:
    most = _most_apart(percent, bins)
    nibble = 0x1111111111111111

    def condition(a: str, b: str) -> Column:
        differ = F.lit(0)
        for k in range(bins // 16):
            x = F.col(f"{a}marks")[k].bitwiseXOR(F.col(f"{b}marks")[k])
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
            x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
            differ = differ + F.bit_count(x.bitwiseAND(F.lit(nibble)))
        sizes = (F.col(f"{a}n") * 100 >= F.col(f"{b}n") * percent) & (F.col(f"{b}n") * 100 >= F.col(f"{a}n") * percent)
        return sizes & (differ <= most)

    return condition


def _sets(shingle: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            sets = shingle_hashes(*word_hashes(batch.column("text")), shingle)
            short = [(h >> np.uint64(32)).astype(np.uint32).tobytes() for h in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([h.tobytes() for h in sets], pa.binary()), pa.array(short, pa.binary())], names=["id", "hashes", "short"])

    return run


def _block_compare(percent: int, bins: int) -> Callable:
    """Pairs whose 32-bit sets are similar enough (which loses none), each under the first key that its two members share."""
    most = _most_apart(percent, bins)

    def compare(keys: np.ndarray, columns: dict[str, pa.Array], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = columns["n"].to_numpy()
        a, b = (x[(100 * n[a] >= percent * n[b]) & (100 * n[b] >= percent * n[a])] for x in (a, b))
        bands, marks = (columns[c].flatten().to_numpy().reshape(len(n), -1) for c in ("bands", "marks"))
        nibbles = np.stack([(marks.view(np.uint64) >> np.uint64(4 * k)) & np.uint64(15) for k in range(16)], axis=2).astype(np.uint8).reshape(len(n), -1)
        sets: dict[int, np.ndarray] = {}
        found: list[tuple[int, int]] = []
        for start in range(0, len(a), 4096):
            x, y = a[start : start + 4096], b[start : start + 4096]
            close = (nibbles[x] != nibbles[y]).sum(axis=1) <= most
            x, y = x[close], y[close]
            same = bands[x] == bands[y]
            own = bands[x, same.argmax(axis=1)] == keys[x]
            for p, q in zip(x[own].tolist(), y[own].tolist(), strict=True):
                for k in (p, q):
                    if k not in sets:
                        sets[k] = np.frombuffer(columns["short"][k].as_buffer(), np.uint32)
                both = np.sort(np.concatenate((sets[p], sets[q])))
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    found.append((p, q))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    return compare


def _similar(percent: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a_hashes"), batch.column("b_hashes"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate((p, q)))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(p) + len(q) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, percent: int = 80, bands: int = 32, rows: int = 4
) -> DataFrame:
    """Groups of documents that chains of links connect: (id_col, n_shingles, component_id, kept), one row a row of `docs`.

    A document's set holds its distinct runs of `shingle` words (A-Z in lower case); with fewer words, the one run of all. Two
    documents are linked if 100 * |intersection| >= percent * |union|. component_id is the smallest id reachable, itself
    included, and kept says whether it is the document's own.

    Null and empty texts, and texts of white space only, have the empty set (0) and no link. Rows that repeat an id are one
    node whose set is that of the text with most shingles (ties: the smallest digest); each gets a row with its own n_shingles. A null
    id has a null component and is kept. Other columns are ignored. An empty table gives an empty table.
    """
    parts = sketches(docs, id_col, text_col, shingle, bands, rows)
    drawn = materialize(parts, "sketches")
    one = drawn.where("id is not null and n > 0").groupBy("id").agg(F.max(F.struct("n", "digest")).alias("top")).select("id", "top.n", "top.digest")
    ids = materialize(one, "ids")
    same = ids.groupBy("digest").agg(F.min("id").alias("rep"))
    ids = ids.join(same, "digest").select("id", "rep", "digest")
    ids = settled(ids, "reps")
    reps = ids.where("id = rep").select("id", "digest")
    unique = settled(drawn.join(reps, ["id", "digest"]).dropDuplicates(["id"]).select("id", "n", "bands", "marks"), "unique")
    keys = unique.select(F.explode("bands").alias("key"), "id")

    def confirm(which: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
        which = settled(which, "which")
        every = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        needed = asked_for(every, which, "id").join(which, "id", "left_semi")
        full = needed.mapInArrow(_sets(shingle), "id long, hashes binary, short binary")
        full = settled(full.withColumn("size", F.length("hashes")).groupBy("id").agg(F.max(F.struct("size", "hashes", "short")).alias("top")).select("id", "top.hashes", "top.short"), "sets")

        def check(pairs: DataFrame) -> DataFrame:
            side = lambda x: full.select(F.col("id").alias(x), F.col("hashes").alias(f"{x}_hashes"))
            return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_similar(percent), "a long, b long")

        return full.select("id", "short").join(unique, "id"), check

    found = groups_by_shared_keys(unique.select("id", "n", "marks"), keys, _may_match(percent, bands * rows), confirm, _block_compare(percent, bands * rows))
    group = found.select(F.col("id").alias("rep"), "component")
    label = ids.join(group, "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    out = drawn.select("id", "n").join(label, "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """The rows of `docs` with all their columns, one row of each group of near duplicates: that of the smallest id.

    Rows without words and rows with a null id all stay. Of rows that repeat an id, one stays: the first by all columns' hash.
    """
    before = made()
    found = near_duplicates(docs, id_col, text_col, **how)
    keep = materialize(found.where(F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("__tm_id")).distinct(), "kept")
    forget_made(before, keep)
    release_shuffles(docs.sparkSession)
    held = docs.join(keep, docs[id_col] == keep["__tm_id"], "left_semi")
    first = F.struct(F.xxhash64(*docs.columns), text_col)
    stay = held.groupBy(F.col(id_col).alias("__tm_id")).agg(F.min_by(F.struct(*docs.columns), first).alias("__tm_row")).select("__tm_row.*")
    return stay.unionByName(docs.where(F.col(id_col).isNull()))
