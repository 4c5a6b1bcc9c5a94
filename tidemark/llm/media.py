"""ISO media containers (ISO/IEC 14496-12): written, walked and described without decoding what they hold.

A file is nested boxes: 4 bytes size (1: 8 more follow, 0: to the end of what it is in), 4 bytes type, content. The tables of a
track's sample table say where each sample's bytes are: sizes, samples in a chunk, chunk offsets, durations and key samples.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import chunks

#: Boxes that hold nothing but boxes.
CONTAINERS = (b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"udta")
RATE, FRAME, PER_CHUNK, KEY_EVERY = 8000, 1024, 8, 16  # samples a second; bytes in a frame; frames in a chunk; frames to a key frame
_DEEPEST = 32


@dataclass
class Track:
    """What the tables of a track say. Offsets and sizes are of its samples, in order."""

    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    number: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))

    @property
    def key_ranges(self) -> list[tuple[int, int]]:
        """First byte and length of each key sample."""
        return [(int(self.offsets[k]), int(self.sizes[k])) for k in self.keys]


def boxes(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """Type, and begin and end of the content, of the boxes side by side in a range. ValueError where they don't fit into it."""
    end = len(data) if end is None else end
    while start < end:
        if start + 8 > end:
            raise ValueError(f"no room for a box at {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError(f"no room for a size at {body}")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if kind == b"uuid":
            body += 16
        if size < body - start or start + size > end:
            raise ValueError(f"a box of {size} bytes at {start} ends outside")
        yield kind, body, start + size
        start += size


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """All boxes, outer before inner: path of types, begin and end of the content."""
    if len(path) > _DEEPEST:
        raise ValueError("boxes are nested too deeply")
    for kind, a, b in boxes(data, start, end):
        yield (*path, kind), a, b
        if kind in CONTAINERS:
            yield from walk(data, a, b, (*path, kind))


def _table(data: memoryview, at: int, end: int, columns: int, kind: str = ">u4") -> np.ndarray:
    n = struct.unpack_from(">I", data, at)[0]
    width = np.dtype(kind).itemsize * columns
    if at + 4 + n * width > end:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, kind, n * columns, at + 4).astype(np.int64).reshape(n, columns)


#: Samples that a file may name besides one for each of its bytes.
_EMPTY = 1024


def _sizes(data: memoryview, tables: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """Of `stsz`, or of `stz2` with fields of 4, 8 or 16 bits."""
    a, b = tables.get(b"stsz") or tables[b"stz2"]
    same, n = struct.unpack_from(">II", data, a + 4)
    if max(n, n * same if b"stsz" in tables else 0) > len(data) + _EMPTY:
        raise ValueError("more samples than the file can hold")
    if b"stsz" in tables:
        return np.full(n, same, np.int64) if same else _table(data, a + 8, b, 1)[:, 0]
    bits = same & 0xFF
    if bits not in (4, 8, 16) or a + 12 + (n * bits + 7) // 8 > b:
        raise ValueError("a table is longer than its box")
    raw = np.frombuffer(data, np.uint8, (n * bits + 7) // 8, a + 12).astype(np.int64)
    if bits == 4:
        return np.stack((raw >> 4, raw & 15), axis=1).reshape(-1)[:n]
    return raw if bits == 8 else raw[::2] * 256 + raw[1::2]


def _samples(data: memoryview, tables: dict[bytes, tuple[int, int]], track: Track) -> None:
    """Sizes, offsets, duration and key samples from a track's sample table; counts are held against the file before anything is made of them."""
    track.sizes = _sizes(data, tables)
    n = len(track.sizes)
    chunk = _table(data, tables[b"stco"][0] + 4, tables[b"stco"][1], 1)[:, 0] if b"stco" in tables else _table(data, tables[b"co64"][0] + 4, tables[b"co64"][1], 1, ">u8")[:, 0]
    runs = _table(data, tables[b"stsc"][0] + 4, tables[b"stsc"][1], 3)
    lengths = np.diff(np.append(runs[:, 0], len(chunk) + 1))
    if len(runs) and (runs[0, 0] != 1 or (lengths < 0).any()):
        raise ValueError("chunks are out of order")
    # both factors have 32 bits at most, and a file few enough chunks for the sum
    if sum(int(x) * int(y) for x, y in zip(runs[:, 1], lengths, strict=True)) != n:
        raise ValueError("chunks and sizes name different numbers of samples")
    held = np.repeat(runs[:, 1], lengths)
    first = np.cumsum(held) - held
    before = np.concatenate(([0], np.cumsum(track.sizes)))[:-1] if n else np.empty(0, np.int64)
    track.offsets = np.repeat(chunk, held) + before - np.repeat(before[np.minimum(first, max(n - 1, 0))] if n else first, held)
    times = _table(data, tables[b"stts"][0] + 4, tables[b"stts"][1], 2)
    track.duration = sum(int(x) * int(y) for x, y in times.tolist())
    track.keys = _table(data, tables[b"stss"][0] + 4, tables[b"stss"][1], 1)[:, 0] - 1 if b"stss" in tables else np.arange(n)
    if n and (track.offsets.min() < 0 or (track.offsets + track.sizes).max() > len(data)) or len(track.keys) and not 0 <= track.keys.min() <= track.keys.max() < n:
        raise ValueError("a sample lies outside the file")


@dataclass
class _Run:
    """A track's part of a fragment: its base and defaults, and where its `trun` boxes are."""

    number: int
    base: int | None = None
    duration: int = 0
    size: int = 0
    flags: int = 0
    runs: list[tuple[int, int]] = field(default_factory=list)


def _header(data: memoryview, a: int, defaults: dict[int, tuple[int, int, int]], moof: int) -> _Run:
    """A fragment's `tfhd`: optional fields follow in the order of their flags."""
    flags, number = struct.unpack_from(">II", data, a)
    out = _Run(number, None, *defaults.get(number, (0, 0, 0)))
    at = a + 8
    if flags & 1:
        out.base, at = struct.unpack_from(">Q", data, at)[0], at + 8
    elif flags & 0x20000:
        out.base = moof
    at += 4 if flags & 2 else 0
    for bit, name in ((8, "duration"), (16, "size"), (32, "flags")):
        if flags & bit:
            setattr(out, name, struct.unpack_from(">I", data, at)[0])
            at += 4
    return out


def _fragment(data: memoryview, run: _Run, moof: int, track: Track) -> None:
    """Adds the samples of a fragment's `trun` boxes. A sample is a key sample if its flags don't say that it isn't a sync sample."""
    place = moof if run.base is None else run.base
    for a, b in run.runs:
        flags, n = struct.unpack_from(">II", data, a)
        flags &= 0xFFFFFF
        at = a + 8
        start = place
        if flags & 1:
            start, at = (moof if run.base is None else run.base) + struct.unpack_from(">i", data, at)[0], at + 4
        first = None
        if flags & 4:
            first, at = struct.unpack_from(">I", data, at)[0], at + 4
        names = [x for bit, x in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
        if n > len(data) + _EMPTY or at + 4 * n * len(names) > b:
            raise ValueError("a run of samples is longer than its box")
        table = np.frombuffer(data, ">u4", n * len(names), at).astype(np.int64).reshape(n, len(names))
        column = lambda x, default: table[:, names.index(x)] if x in names else np.full(n, default, np.int64)  # noqa: B023, E731
        sizes, marks = column("size", run.size), column("flags", run.flags).copy()
        if first is not None and n:
            marks[0] = first
        place = start + int(sizes.sum())
        if n and (start < 0 or place > len(data)):
            raise ValueError("a sample lies outside the file")
        track.keys = np.concatenate((track.keys, len(track.sizes) + np.flatnonzero(marks & 0x10000 == 0)))
        track.offsets = np.concatenate((track.offsets, start + np.cumsum(sizes) - sizes))
        track.sizes = np.concatenate((track.sizes, sizes))
        track.duration += int(column("duration", run.duration).sum())


def tracks(file: bytes) -> list[Track]:
    """The tracks of a file, samples of its fragments included. ValueError if it is damaged.

    Durations are those of the samples: edit lists and composition offsets, which say when samples are shown, are not applied. A fragment
    whose header gives no base begins where its `moof` box does.
    """
    data, found, tables, defaults = memoryview(file), [], [], {}
    pieces: list[tuple[int, _Run]] = []
    moof = 0
    for path, a, b in walk(data):
        kind = path[-1]
        if kind == b"moof":
            moof = a - 8
        elif kind == b"trak":
            found.append(Track())
            tables.append({})
        elif kind == b"trex" and path[-2:-1] == (b"mvex",):
            number, _, *rest = struct.unpack_from(">5I", data, a + 4)
            defaults[number] = tuple(rest)
        elif path[-2:-1] == (b"traf",):
            if kind == b"tfhd":
                pieces.append((moof, _header(data, a, defaults, moof)))
            elif kind == b"trun":
                if not pieces or pieces[-1][0] != moof:
                    raise ValueError("a run of samples without a header")
                pieces[-1][1].runs.append((a, b))
        elif b"trak" not in path:
            continue
        elif kind == b"tkhd":
            found[-1].number = struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]
        elif kind == b"mdhd":
            found[-1].timescale = struct.unpack_from(">I", data, a + (20 if data[a] else 12))[0]
        elif kind == b"hdlr" and path[-2] == b"mdia":
            found[-1].handler = bytes(data[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"stsd" and struct.unpack_from(">I", data, a + 4)[0]:
            found[-1].codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
        elif path[-2] == b"stbl":
            tables[-1][kind] = (a, b)
    for track, own in zip(found, tables, strict=True):
        if not {b"stsc", b"stts"} <= own.keys() or not {b"stsz", b"stz2"} & own.keys() or not {b"stco", b"co64"} & own.keys():
            raise ValueError("a sample table lacks a table")
        _samples(data, own, track)
    by = {t.number: t for t in found}
    total = sum(len(t.sizes) for t in found)
    for at, run in pieces:
        if run.number not in by:
            raise ValueError(f"a fragment of a track {run.number} that isn't there")
        total += sum(struct.unpack_from(">I", data, a + 4)[0] for a, _ in run.runs)
        if total > len(data) + _EMPTY:
            raise ValueError("more samples than the file can hold")
        _fragment(data, run, at, by[run.number])
    return found


def payload(file: bytes, track: Track) -> bytes:
    """The bytes of a track's samples, in order."""
    return b"".join(file[o : o + s] for o, s in zip(track.offsets.tolist(), track.sizes.tolist(), strict=True))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, bytes(4), *parts)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def build(data: bytes) -> bytes:
    """A file with one sound track of unsigned 8-bit mono samples ('raw '), which hold `data` byte for byte in frames of 1024."""
    frames = -(-len(data) // FRAME)
    sizes = [FRAME] * (frames - 1) + [len(data) - FRAME * (frames - 1)] if frames else []
    chunks_ = -(-frames // PER_CHUNK)
    tail = frames - PER_CHUNK * (chunks_ - 1)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    first = len(head) + 8  # the payload comes before the tables, so its place is known
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    runs = [(1, PER_CHUNK, 1)] if chunks_ and tail == PER_CHUNK else [(1, PER_CHUNK, 1), (chunks_, tail, 1)] if chunks_ > 1 else [(1, tail, 1)] if chunks_ else []
    times = [(frames - 1, FRAME), (1, sizes[-1])] if frames > 1 else [(1, sizes[0])] if frames else []
    keys = range(1, frames + 1, KEY_EVERY)
    table = lambda kind, rows, n: _full(kind, struct.pack(">I", len(rows)), struct.pack(f">{n * len(rows)}I", *(x for r in rows for x in r)))
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        table(b"stts", times, 2),
        table(b"stss", [(k,) for k in keys], 1),
        table(b"stsc", runs, 3),
        _full(b"stsz", struct.pack(">II", 0, frames), struct.pack(f">{frames}I", *sizes)),
        table(b"stco", [(first + k * PER_CHUNK * FRAME,) for k in range(chunks_)], 1),
    )
    dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1")))
    minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, len(data), 0x55C4, 0)), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"), minf)
    tkhd = _box(b"tkhd", b"\0\0\0\7", struct.pack(">IIIIIIIHHHH", 0, 0, 1, 0, len(data), 0, 0, 0, 0, 0x100, 0), _MATRIX, bytes(8))
    mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, len(data), 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
    return b"".join((head, _box(b"mdat", data), _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))))


def _columns_of(t: Track) -> dict[str, object]:
    ranges = [{"offset": o, "length": n} for o, n in t.key_ranges]
    return {"codec": t.codec, "handler": t.handler, "duration_s": t.duration / t.timescale if t.timescale else None, "n_samples": len(t.sizes), "key_ranges": ranges}


def describe(file: bytes) -> dict[str, object]:
    """Columns of a media file: codec, handler, duration in seconds, samples, key sample byte ranges; of its first track, and of each in `tracks`.

    A null or damaged file has nulls and says in `error` why; a file without a track has no codec and no sample.
    """
    try:
        found = tracks(file)
    except (ValueError, struct.error, KeyError, IndexError, TypeError, OverflowError) as e:
        return {"codec": None, "handler": None, "duration_s": None, "n_samples": None, "key_ranges": None, "tracks": None, "error": str(e) or "damaged"}
    if not found:
        return {"codec": None, "handler": None, "duration_s": 0.0, "n_samples": 0, "key_ranges": [], "tracks": [], "error": None}
    own = [_columns_of(t) for t in found]
    return own[0] | {"tracks": own, "error": None}


_TRACK = "codec: string, handler: string, duration_s: double, n_samples: long, key_ranges: array<struct<offset: long, length: long>>"
DESCRIBED = f"codec string, handler string, duration_s double, n_samples long, key_ranges array<struct<offset: long, length: long>>, tracks array<struct<{_TRACK}>>, error string"


def describe_files(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id_col, and the columns of `describe`) of each row's file. Only boxes and tables are read; no payload is decoded."""
    kind = files.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = batch.schema.names[1]
            for part in chunks(iter([batch]), content):
                yield pa.RecordBatch.from_pylist([{id_col: k.as_py()} | describe(x) for k, x in zip(part.column(0), part.column(1).to_pylist(), strict=True)], schema=shape)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"`{id_col}` {kind}, {DESCRIBED}"
    shape = to_arrow_schema(StructType.fromDDL(schema))
    return files.select(id_col, F.col(content_col).cast("binary")).mapInArrow(run, schema)


_STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, n_samples long, n_keyframes long"


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        rows = []
        for key, text in zip(batch.column("id").to_pylist(), batch.column("text").fill_null("").cast(pa.binary()).to_pylist(), strict=True):
            file = build(text + bytes(-len(text) % 64 or (0 if text else 64)))
            track = tracks(file)[0]
            back = payload(file, track)
            keys = track.key_ranges
            feature = f"{track.handler}/{track.codec.strip()} {track.duration}/{track.timescale} samples={len(track.sizes)} keys=" + ",".join(f"{o}+{n}" for o, n in keys)
            rows.append((key, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature, track.codec, track.duration / track.timescale, len(track.sizes), len(keys)))
        kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        fields = [x.split() for x in _STORED.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a media file, walks that file again and describes it.

    The payload is the text's UTF-8 bytes (null: none) and zero bytes up to a positive multiple of 64. All columns but n_bytes are
    from the file's own boxes and tables. Equal texts have equal files. Other columns are ignored.
    """
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_store, _STORED)
