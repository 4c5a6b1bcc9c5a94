"""Runs of bytes of a class in UTF-8 texts, cut out all at once: for words that no function of Arrow splits as wanted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import feature_hashes, mix

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def lowered(outside: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(what each byte becomes, A-Z in lower case; which bytes are inside a run): all bytes but those in `outside`."""
    low, inside = np.arange(256, dtype=np.uint8), np.ones(256, bool)
    low[65:91] += 32
    inside[list(outside)] = False
    return low, inside


def runs(texts: pa.Array, table: tuple[np.ndarray, np.ndarray], breaks: bytes = b"") -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, one more than texts, into the runs; each run's piece; all runs, in lower case).

    Null is the empty text. A run ends with its text. A piece ends with its text and at each of the bytes `breaks`, which are outside runs.
    """
    texts = pc.fill_null(texts, "")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    low, known = table
    inside = known[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    new = ends[:-1][np.diff(ends) > 0]  # where texts begin
    first[new] = inside[new]
    starts = np.flatnonzero(first)
    at = np.flatnonzero(first[inside])
    held = low[data[inside]]
    offsets = np.append(at, len(held)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(held))
    piece = np.zeros(len(starts), np.int64)
    if breaks:
        stops = np.zeros(256, bool)
        stops[list(breaks)] = True
        marks = stops[data].astype(np.int32)
        marks[new] += 1
        piece = np.cumsum(marks)[starts].astype(np.int64)
    return np.searchsorted(starts, ends), piece, words


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(each word's place among the distinct ones, the distinct ones, their 64-bit hashes)."""
    found = words.dictionary_encode()
    known = found.dictionary
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), known, feature_hashes(known) if len(known) else np.empty(0, np.uint64)


def salted(hashes: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Hashes of pairs of a hash and a number."""
    with np.errstate(over="ignore"):
        return mix(hashes * _GOLDEN + np.asarray(salt).astype(np.uint64))


def name_hashes(names: pa.Array) -> np.ndarray:
    """A 64-bit hash of each name; null and the empty name are told apart."""
    if not len(names):
        return np.empty(0, np.uint64)
    found = pc.fill_null(names, "").dictionary_encode()
    h = feature_hashes(found.dictionary)[found.indices.to_numpy(zero_copy_only=False)]
    return np.where(pc.is_null(names).to_numpy(zero_copy_only=False), np.uint64(0), h)
