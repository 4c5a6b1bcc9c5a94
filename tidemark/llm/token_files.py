"""Token ids in files of length-delimited binary records, with an index beside each file for reads in any order.

A record is: 8 bytes length of the payload, 4 bytes masked checksum of those 8, the payload, 4 bytes masked checksum of the
payload; all integers are little-endian. The checksum is zlib's CRC-32 (the reader needs no other library), rotated right by 15
bits plus 0xA282EAD8, so that a checksum stored in checksummed data does no harm. The payload is 1 byte (1: has an id),
8 bytes document id, then the token ids, of 2 bytes each if the vocabulary fits and else of 4.

An index has 24 bytes a record: offset of the record in its file, document id, number of token ids.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import new_path
from .text import WordwiseTokenizer, chunks

_HEAD, _SUM, _ID = "<Q", "<I", "<Bq"  # as struct has them
_INDEX = np.dtype([("offset", "<u8"), ("doc_id", "<i8"), ("n", "<u8")])


def masked(data: bytes) -> int:
    """The checksum that is stored for `data`."""
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    size = struct.pack(_HEAD, len(payload))
    return b"".join((size, struct.pack(_SUM, masked(size)), payload, struct.pack(_SUM, masked(payload))))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at an offset, and the offset after it; ValueError if a checksum doesn't hold."""
    size = bytes(data[at : at + 8])
    if len(size) < 8 or struct.unpack_from(_SUM, data, at + 8)[0] != masked(size):
        raise ValueError(f"damaged length at {at}")
    end = at + 12 + struct.unpack(_HEAD, size)[0]
    payload = data[at + 12 : end]
    if len(data) < end + 4 or struct.unpack_from(_SUM, data, end)[0] != masked(payload):
        raise ValueError(f"damaged payload at {at}")
    return payload, end + 4


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _writer(folder: str, tokenizer: str, end_id: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordwiseTokenizer.at(tokenizer)
        kind = np.dtype("<u2" if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        store, root = _open(folder)
        out, index, at, ids = None, [], 0, 0
        name = f"{root}/{uuid.uuid4().hex}"  # of this attempt alone: a lost task's file is never referred to
        first = None
        for batch in chunks(batches, "text"):
            if out is None:
                store.create_dir(root, recursive=True)
                out, first = store.open_output_stream(f"{name}.rec"), batch.column("id")[0].as_py()
            ends, flat = encoder.encode(batch.column("text"))
            flat = flat.astype(kind)
            tail = np.array([end_id], kind).tobytes()
            for key, a, b in zip(batch.column("id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                record = frame(struct.pack(_ID, key is not None, key or 0) + flat[a:b].tobytes() + tail)
                index.append((at, key or 0, b - a + 1))
                out.write(record)
                at += len(record)
                ids += b - a + 1
        if out is not None:
            out.close()
            with store.open_output_stream(f"{name}.idx") as f:
                f.write(np.array(index, _INDEX).tobytes())
            yield pa.RecordBatch.from_pylist(
                [{"file": name, "first_id": first, "records": len(index), "ids": ids, "width": kind.itemsize}],
                schema=pa.schema([("file", pa.string()), ("first_id", pa.int64()), ("records", pa.int64()), ("ids", pa.int64()), ("width", pa.int32())]),
            )

    return run


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", *, folder: str | None = None
) -> DataFrame:
    """Writes every text's ids and `end_id` in ascending id order, a file for each range of ids: the files, in their order.

    Returns (file, first_id, records, ids, width, start: ids in all files before it). `folder` is a URI that all executors can
    write to, by default in the shared folder. Null and empty texts are records of `end_id` alone; rows with a null id come first;
    rows that repeat an id follow each other, in the order of their texts. Other columns are ignored. Without rows there is no file.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-files")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(F.col("id")).sortWithinPartitions(F.col("id"), F.col("text"))
    written = rows.mapInArrow(_writer(folder, tokenizer, end_id), "file string, first_id long, records long, ids long, width int")
    # a row a file, of ranges that don't overlap: as few as there are partitions
    files = sorted(written.collect(), key=lambda r: (r.first_id is not None, r.first_id or 0))
    starts = np.concatenate(([0], np.cumsum([r.ids for r in files]))).tolist()
    kinds = "file string, first_id long, records long, ids long, width int, start long, store string"
    listed = [(r.file, r.first_id, r.records, r.ids, r.width, s, folder) for r, s in zip(files, starts, strict=False)]
    return spark.createDataFrame(listed, kinds).repartition(max(1, len(listed)))


def _reader(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, _ = _open(row["store"])
            with store.open_input_file(f"{row['file']}.idx") as f:
                index = np.frombuffer(f.read(), _INDEX)
            start, ids, n, crc = row["start"], [], index["n"].astype(np.int64), []
            kind = np.dtype(f"<u{row['width']}")
            with store.open_input_file(f"{row['file']}.rec") as f:
                size = f.size()
                for a in range(0, len(index), 2048):  # so many records at once
                    begin, stop = int(index["offset"][a]), int(index["offset"][a + 2048]) if a + 2048 < len(index) else size
                    data, at = memoryview(f.read_at(stop - begin, begin)), 0
                    for _ in range(a, min(a + 2048, len(index))):
                        payload, at = unframe(data, at)
                        has, key = struct.unpack_from(_ID, payload)
                        ids.append(key if has else None)
                        crc.append(zlib.crc32(np.frombuffer(payload[9:], kind).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
            )


def read_token_files(files: DataFrame) -> DataFrame:
    """What `write_token_files` wrote, checked against its checksums: (doc_id, start, n_tokens, ids_crc32), a row a record."""
    return files.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_record(store: str, file: str, position: int, width: int) -> tuple[int | None, np.ndarray]:
    """One record by its place in a file, through the index."""
    fs, _ = _open(store)
    with fs.open_input_file(f"{file}.idx") as f:
        offset = int(np.frombuffer(f.read_at(_INDEX.itemsize, position * _INDEX.itemsize), _INDEX)["offset"][0])
    with fs.open_input_file(f"{file}.rec") as f:
        size = struct.unpack(_HEAD, f.read_at(8, offset))[0]
        payload, _ = unframe(memoryview(f.read_at(size + 16, offset)), 0)
    has, key = struct.unpack_from(_ID, payload)
    return key if has else None, np.frombuffer(payload[9:], np.dtype(f"<u{width}")).astype(np.uint32)
