"""Best-fit packing of token sequences, certified by lower bounds.

Pieces are dealt to buckets by hash; each bucket is packed by best-fit decreasing and held against lower bounds from
dual-feasible functions (Fekete and Schepers, 2001), which no packing of its pieces can beat. Buckets with a gap give back the
pieces of their emptiest sequences, and every bucket gives back sequences that are less than half full; what came back is dealt
anew, into fewer buckets, and packed again, until one bucket has packed the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, numbered
from .text import WordwiseTokenizer, chunks

#: Pieces in a bucket, about: the largest group that one task holds.
BUCKET = 8192
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def lower_bound(sizes: np.ndarray, capacity: int, most: int = 24) -> int:
    """The largest of several lower bounds on the number of bins: exact integers throughout.

    Dual-feasible functions: u_k for k to `most`, which rounds a size times k + 1 down, and f_a for each a to half the capacity, which
    takes sizes above capacity - a as a whole bin and those below a as nothing.
    """
    x = np.sort(sizes.astype(np.int64))
    if not len(x):
        return 0
    best = -(-int(x.sum()) // capacity)
    for k in range(1, most + 1):
        y = (k + 1) * x
        best = max(best, -(-int(np.where(y % capacity == 0, k * x, capacity * (y // capacity)).sum()) // (k * capacity)))
    total = np.concatenate(([0], np.cumsum(x)))
    a = np.unique(x[2 * x <= capacity])
    low, high = np.searchsorted(x, a, "left"), np.searchsorted(x, capacity - a, "right")
    if len(a):
        best = max(best, int((-(-((total[high] - total[low]) + capacity * (len(x) - high)) // capacity)).max()))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each size (given in descending order), and what each bin holds."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what still fits
    mask, held, bins, offsets = 0, [], [], []
    for size in sizes.tolist():
        fits = mask >> size
        if fits:
            left = (fits & -fits).bit_length() - 1 + size
            k = room[left].pop()
            if not room[left]:
                mask &= ~(1 << left)
        else:
            k, left = len(held), capacity
            held.append(0)
        bins.append(k)
        offsets.append(held[k])
        held[k] += size
        left -= size
        if left:
            room[left].append(k)
            mask |= 1 << left
    return np.array(bins, np.int64), np.array(offsets, np.int64), np.array(held, np.int64)


def _pieces(tokenizer: str, end_id: int, capacity: int, remember: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordwiseTokenizer.at(tokenizer, remember)
        for batch in chunks(batches, "text"):
            ends, flat = encoder.encode(batch.column("text"))
            flat, tail = flat.astype("<u4"), np.array([end_id], "<u4")
            out: tuple[list, ...] = ([], [], [], [], [])
            for key, a, b in zip(batch.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                ids = np.concatenate((flat[a:b], tail))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    for column, x in zip(out, (key, k, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", remember: int = 1_000_000) -> DataFrame:
    """Each document's ids and `end_id`, cut only where longer than `capacity`: (doc_id, piece, start, length, ids_crc32).

    A worker remembers the ids of so many pieces of words, about 200 bytes each; with fewer it is slower, not different.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, end_id, capacity, remember), _PIECE)


def _packer(capacity: int, turn: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32", "copy"], ascending=[False, True, True, True, True], ignore_index=True)
        sizes = group["length"].to_numpy()
        bins, offsets, held = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        back = np.zeros(len(held), bool)
        if not last:
            back = held * 2 < capacity
            if len(held) > bound:  # not certified: its emptiest sequences go into the next exchange
                worst = np.argsort(held, kind="stable")[: max(8, len(held) // 8)]
                back[worst[held[worst] < capacity]] = True
        group["sequence_id"] = (turn << 56) + (group["bucket"].to_numpy() << 24) + bins
        group["offset"], group["back"], group["bins"], group["bound"] = offsets, back[bins], len(held), bound
        return group

    return run


def pack(pieces: DataFrame, capacity: int = 2048, bucket: int = BUCKET) -> DataFrame:
    """Places pieces into sequences of at most `capacity`: the rows with sequence_id, offset, and their bucket's bins and bound.

    `pieces` has doc_id, piece, start, length (1 to capacity) and ids_crc32. Pieces in a sequence leave no gap. Pieces as long as
    a sequence are one each, without a search. Equal input gives equal sequences, up to their numbers. `bins` and `bound` are the number of sequences of
    the bucket that placed the row in its last turn and the least that any packing of that bucket's pieces has. Pieces with a null
    doc_id are packed like others. Without rows there are none.
    """
    # equal pieces, as those of empty texts without an id, would all meet in one bucket
    pieces = materialize(numbered(pieces.select(*(x.split()[0] for x in _PIECE.split(", ")))), "pieces")
    own = [c for c in pieces.columns if c != "copy"]
    kinds = f"{_PIECE}, copy long, bucket long, sequence_id long, offset long, back boolean, bins long, bound long"
    spread = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32", "copy")
    whole = pieces.where(F.col("length") == capacity)
    alone = whole.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bins": F.lit(1).cast("long"), "bound": F.lit(1).cast("long")})
    done = [alone.select(*own, "sequence_id", "offset", "bins", "bound")]
    rest, turn, count = pieces.where(F.col("length") < capacity), 0, 0
    while True:
        n = rest.count()
        if not n:
            break
        # each exchange has fewer buckets than the one before, so that the last, of one bucket, is reached whatever comes back
        count = min(-(-n // bucket), count * 7 // 8 if count else n)
        count = max(1, count)
        dealt = rest.select(*pieces.columns, F.pmod(F.xxhash64(spread, F.lit(turn)), F.lit(count)).alias("bucket"))
        placed = materialize(dealt.groupBy("bucket").applyInPandas(_packer(capacity, turn + 1, count == 1), kinds), "placed")
        done.append(placed.where("not back").select(*own, "sequence_id", "offset", "bins", "bound"))
        rest, turn = placed.where("back").select(*pieces.columns), turn + 1
    return reduce(DataFrame.union, done)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", remember: int = 1_000_000) -> DataFrame:
    """Tokenizes and packs documents; null texts count as empty, whose one piece is `end_id`. See `token_pieces` and `pack`."""
    return pack(token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, remember), capacity)
