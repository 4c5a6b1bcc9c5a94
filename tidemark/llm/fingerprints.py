"""Document fingerprints by a threshold-scaled sketch: every shingle hash below a fixed fraction of all hashes.

Whether a hash is kept doesn't depend on the others, so sketches of parts merge into the sketch of the whole, and the share of one
sketch that another holds estimates containment, however unequal the two documents are. Shingles are runs of `WIDTH` UTF-8 bytes;
a shorter text is one shingle, which is kept in any case. Of a text whose hashes all miss the threshold, as those of short texts may,
the least hash is kept, so that only the empty text has the empty fingerprint; a merged sketch may hold such a hash besides. Texts
with few kept hashes may share all of them: equal fingerprints are no proof of equal texts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import mix, powers

WIDTH, FRACTION = 12, 16  # bytes in a shingle; one in so many hashes is kept


def sketch(data: bytes, width: int = WIDTH, fraction: int = FRACTION) -> np.ndarray:
    """The kept hashes (32 bits of each, distinct, ascending); none for an empty text."""
    n = len(data)
    if n < width:
        return np.array([xxhash.xxh3_64_intdigest(data) >> 32] if n else [], np.uint32)
    up, down = powers(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n])))
        hashes = mix((sums[width:] - sums[:-width]) * down[: n - width + 1])
    least = hashes[hashes < np.uint64(2**64 // fraction)]
    if not len(least):
        least = hashes.min(keepdims=True)
    # the kept ones lie in the lowest part of all hashes: the 32 bits that follow the bits they share
    with np.errstate(over="ignore"):
        kept = np.sort(((least * np.uint64(fraction)) >> np.uint64(32)).astype(np.uint32))
    return kept[np.concatenate(([True], kept[1:] != kept[:-1]))] if len(kept) else kept


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many hashes two sketches share."""
    both = np.sort(np.concatenate((a, b)))
    return int((both[1:] == both[:-1]).sum())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated resemblance: shared hashes among all of both; 1 for two empty sketches, which only empty texts have."""
    both = shared(a, b)
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    return shared(a, b) / len(a) if len(a) else 1.0


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of both documents' shingles together."""
    return np.unique(np.concatenate((a, b)))


def to_text(hashes: np.ndarray) -> str:
    """A fingerprint as text: base64 of the hashes as little-endian 32-bit integers."""
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u4")


def _print(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [to_text(sketch(x)) for x in batch.column("text").fill_null("").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.string())], names=["id", "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) of each row; null and empty texts have the empty fingerprint. Other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_print, "id long, fingerprint string").withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the start of `following`, or by all of it."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_EDIT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in chains (rank, then descending id); the last of each chain is only there for the one before it."""
    held: tuple | None = None
    out: list[tuple] = []
    size = 0

    def batch_of() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in _EDIT.split(", ")])

    for batch in batches:
        for chain, key, guest, text in zip(*(batch.column(c).to_pylist() for c in ("chain", "id", "guest", "text")), strict=True):
            text = text or ""
            own = sketch(text.encode())
            if held is not None and held[0] == chain:
                _, before, old, mark = held
                new = edited(old, text)
                data = new.encode()
                other = sketch(data)
                out.append((before, len(old), hashlib.sha256(data).hexdigest(), to_text(mark), to_text(other), likeness(mark, other), likeness(mark, own)))
                size += len(old)
            held = None if guest else (chain, key, text, own)
            if size > 8_000_000 or len(out) >= 5000:
                yield batch_of()
                out, size = [], 0
    yield batch_of()


#: Documents in a range of ids, about, and the most ranges: their bounds are in the plan.
RANGE, MOST_RANGES = 4096, 4096


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chains: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text (see `edited`), and how like they and the next text's are.

    The next document is the one with the next smaller id, and the one with the largest after the last; a single document is its own
    next. Rows that repeat an id follow each other in the order of their texts; rows with a null id come last. Null texts count as
    empty. Returns doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents are dealt into ranges of ids, as many as their number asks for, whose bounds are quantiles of the ids; the first document of each
    range is also sent, as a guest, to the range before it, so that one shuffle of the texts is enough and no range depends on another.
    A range is read as a stream, in order; rows of one id, null included, are in one range.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = chains or max(1, min(MOST_RANGES, -(-rows.count() // RANGE)))
    cuts = rows.agg(F.percentile_approx("id", [k / n for k in range(1, n)], 100_000).alias("cuts")).first().cuts or [] if n > 1 else []
    cuts = sorted(set(cuts))  # range k has the ids in [cuts[k - 2], cuts[k - 1]), so that copies of an id stay together; 0 has the null ids
    # a bound's place in two steps: among every `step`-th bound, then among those that follow it
    step = max(1, round(len(cuts) ** 0.5))
    upto = lambda bounds: F.array_size(F.filter(bounds, lambda x: x <= F.col("id")))
    if cuts:
        parts = [cuts[k : k + step] for k in range(0, len(cuts), step)]
        fine = F.array(*(F.array(*map(F.lit, p)) for p in parts))
        coarse = upto(F.array(*(F.lit(p[0]) for p in parts)))
        found = F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + upto(F.element_at(fine, F.greatest(coarse, F.lit(1)))))
    else:
        found = F.lit(0)
    tagged = rows.withColumn("chain", F.when(F.col("id").isNull(), F.lit(0)).otherwise(found + 1))
    heads = tagged.groupBy("chain").agg(F.max("id").alias("id")).collect()  # a row a range
    if not heads:
        return docs.sparkSession.createDataFrame([], _EDIT)
    ranges = sorted((r.chain for r in heads), reverse=True)
    first = {r.chain: r.id for r in heads}
    before = {c: ranges[k - 1] for k, c in enumerate(ranges)}  # the range that ends where c begins; the last one's is the first
    known = range(ranges[0] + 1)
    at = lambda values, kind: F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("chain") + 1)
    guests = tagged.where(F.col("id").eqNullSafe(at([first.get(c) for c in known], "long")))
    guests = guests.groupBy("chain").agg(F.min("text").alias("text"), F.first("id").alias("id"))
    every = tagged.select("chain", "id", F.lit(False).alias("guest"), "text").union(guests.select(at([before.get(c) for c in known], "int"), "id", F.lit(True), "text"))
    dealt = every.repartitionById(len(known), F.col("chain").cast("int")).sortWithinPartitions("chain", "guest", F.col("id").desc_nulls_last(), "text")
    return dealt.select("chain", "id", "guest", "text").mapInArrow(_compare, _EDIT)
