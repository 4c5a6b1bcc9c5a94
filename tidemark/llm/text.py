"""Vectorised text kernels shared by the Arrow-based operators.

All of them work on whole texts, a few megabytes at a time, and treat null as the empty text. Words are maximal runs of
anything but ASCII white space (``[^\\x20\\x09-\\x0D]+``).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that a kernel takes at once. A single longer text is still taken whole.
CHUNK_BYTES = 4 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: spreads each unsigned 64-bit number over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def release() -> None:
    """Gives memory that is free again back to the system: workers stay, and other stages of other kinds need it next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def chunks(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `most` bytes in `column`. After the last, free memory is released."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
    release()


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets (one more than texts) into the flat array of all words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, starts = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not real.all():  # white space at an end of a text leaves an empty string there
        starts = np.concatenate(([0], np.cumsum(real)))[starts]
        flat = flat.filter(pa.array(real))
    return starts, flat


def encoded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets, each word's place in a dictionary, and the dictionary."""
    starts, flat = words(texts)
    coded = flat.dictionary_encode()
    return starts, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, and a 64-bit hash of each word (A-Z in lower case first if `lower`)."""
    starts, place, known = encoded_words(pc.ascii_lower(pc.fill_null(texts, "")) if lower else texts)
    digest = xxhash.xxh3_64_intdigest
    return starts, np.fromiter((digest(w) for w in known.cast(pa.binary()).to_pylist()), np.uint64, len(known))[place]


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", int(_GOLDEN)), ("down", pow(int(_GOLDEN), -1, 1 << 64))):
                _POWERS[name] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base, np.uint64))))
    return _POWERS["up"], _POWERS["down"]


def feature_hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, of all strings at once: the polynomial of its bytes, spread over all bits.

    For features that vote. Long strings can be made to collide, so it is no proof that two are equal.
    """
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64)
    ends = ends - ends[0]
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * up[: len(data)])))
        return mix((sums[ends[1:]] - sums[ends[:-1]]) * down[ends[:-1]])


def shingle_hashes(starts: np.ndarray, hashes: np.ndarray, n: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of n words; of all its words as one if it has fewer; none without words."""
    with np.errstate(over="ignore"):
        power = _GOLDEN
        rolled = hashes.copy()
        for k in range(1, n):
            power = power * _GOLDEN
            rolled[: max(0, len(rolled) - k)] += hashes[k:] * (power + np.uint64(2 * k))
        out = []
        whole = mix(rolled)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a >= n:
                h = np.sort(whole[a : b - n + 1])
                out.append(h[np.concatenate(([True], h[1:] != h[:-1]))])
            elif b > a:
                h = np.uint64(b - a)
                for x in hashes[a:b]:
                    h = mix(np.array([h * _GOLDEN + x]))[0]
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
    return out


#: A run of marks after a letter or digit of these, at the end of a word, is a token of its own.
_MARKS = ".,;:!?"
_ENDS = "[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]$"


class WordwiseTokenizer:
    """Exact ids of a tokenizer whose tokens never span white space, with each distinct word encoded once.

    Only for tokenizers that lower-case and drop white space before they split (checked on construction); for those, the ids of a
    text are the ids of its words in turn, and those of a word that ends in marks after a letter or digit are the ids of its body and
    of its marks. What it remembers is bounded by `most` pieces and then forgotten.
    """

    _kept: dict[str, WordwiseTokenizer] = {}

    def __init__(self, path: str, most: int = 1_000_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        probe = " It's  a\tPROBE,\r\n\x0bof 12!? words\x0c \u00e9\x1f. "
        ids = self.tokenizer.encode(probe, add_special_tokens=False).ids
        parts = [x for w in probe.lower().replace("e,", "e ,").replace("2!", "2 !").encode().split() for x in self.tokenizer.encode(w.decode(), add_special_tokens=False).ids]
        if ids != parts:
            raise ValueError(f"the tokens of {path} depend on white space or case")
        self._clear()

    def _clear(self) -> None:
        self.pieces: dict[str, int] = {"": 0}  # a piece's place in start and length
        self.ids, self.start, self.length = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    @classmethod
    def at(cls, path: str, most: int = 1_000_000) -> WordwiseTokenizer:
        """One instance per process and file; the last caller's bound holds."""
        if path not in cls._kept:
            cls._kept[path] = cls(path, most)
        cls._kept[path].most = most
        return cls._kept[path]

    def _learn(self, pieces: list[str]) -> None:
        """Several thousand pieces go through the tokenizer as one text, and offsets tell them apart."""
        self.pieces.update(zip(pieces, range(len(self.pieces), len(self.pieces) + len(pieces)), strict=True))
        starts, lengths, ids, used = [self.start], [self.length], [self.ids], len(self.ids)
        for a in range(0, len(pieces), 2048):
            some = pieces[a : a + 2048]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            begins = np.array(got.offsets, np.int64).reshape(-1, 2)[:, 0]
            ends = np.searchsorted(begins, np.cumsum([len(x) + 1 for x in some]))
            lengths.append(np.diff(ends, prepend=0))
            starts.append(used + ends - lengths[-1])
            ids.append(np.array(got.ids, np.uint32))
            used += len(ids[-1])
        self.start, self.length, self.ids = map(np.concatenate, (starts, lengths, ids))

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Each piece's place."""
        coded = pieces.dictionary_encode()
        listed = coded.dictionary.to_pylist()
        known = self.pieces
        place = [known.get(x, -1) for x in listed]
        new = [x for x, k in zip(listed, place, strict=True) if k < 0]
        if new:
            base = len(known)
            self._learn(new)
            fresh = np.array(place, np.int64)
            fresh[fresh < 0] = np.arange(base, base + len(new))
            return fresh[coded.indices.to_numpy()]
        return np.array(place, np.int64)[coded.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets (one more than texts) into the flat ids (unsigned 32 bits)."""
        starts, at, known = encoded_words(texts)
        low = pc.ascii_lower(known)
        body = pc.utf8_rtrim(low, _MARKS)
        split = pc.and_(pc.not_equal(body, low), pc.match_substring_regex(body, _ENDS))
        marked = low.filter(split)
        body = pc.if_else(split, body, low)
        if len(self.pieces) + len(body) > self.most:
            self._clear()
        halves = np.zeros((len(known), 2), np.int64)
        halves[:, 0] = self._places(body)
        halves[split.to_numpy(zero_copy_only=False), 1] = self._places(pc.struct_field(pc.extract_regex(marked, "(?P<marks>[.,;:!?]+)$"), "marks"))
        halves = halves[at].reshape(-1)
        length = self.length[halves]
        ends = np.concatenate(([0], np.cumsum(length)))
        take = np.arange(ends[-1]) + np.repeat(self.start[halves] - ends[:-1], length)
        return ends[starts * 2], self.ids[take]
