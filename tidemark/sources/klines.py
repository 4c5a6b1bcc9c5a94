"""Candles in a folder of JSON files as a data source of Spark: `spark.read.format("klines")` and `spark.readStream.format("klines")`.

    folder/symbol=S/interval=I/NAME.json

A file is an array of kline arrays (open time in epoch milliseconds, open, high, low, close, volume, ..), or has one on each line; its name
fits the option `glob` (*.json). Each file is a partition. Filters
on symbol and interval, by `=` or `IN`, are taken before any file is opened. A stream's offset is the last file that was read, by time of
its last change and path: a file must be moved into the folder when it is whole, and isn't read again. Paths are opened by Arrow's file
systems, so that they can be local or shared folders or stores that Arrow knows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch
from urllib.parse import unquote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "symbol string, interval string, ts timestamp, open double, high double, low double, close double, volume double"


@dataclass
class KlineFile(InputPartition):
    path: str
    symbol: str
    interval: str
    changed: int = 0


def _listed(folder: str, glob: str) -> list[KlineFile]:
    """All files, by last change and path."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    found = []
    for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = {k: unquote(v) for k, v in (p.split("=", 1) for p in info.path.split("/") if "=" in p)}
        if info.type == fs.FileType.File and fnmatch(info.base_name, glob) and info.base_name[0] not in "._" and {"symbol", "interval"} <= parts.keys():
            found.append(KlineFile(info.path, parts["symbol"], parts["interval"], info.mtime_ns or 0))
    return sorted(found, key=lambda f: (f.changed, f.path))


def _rows(folder: str, file: KlineFile) -> Iterator[tuple]:
    from datetime import datetime, timezone

    from pyarrow import fs

    system = fs.FileSystem.from_uri(folder)[0] if "://" in folder else fs.LocalFileSystem()
    with system.open_input_stream(file.path) as stream:
        text = stream.read().decode()
    try:
        listed = [json.loads(text or "[]")]
    except ValueError:
        listed = [json.loads(line) for line in text.splitlines() if line.strip()]
    for k in (k for some in listed for k in some):
        yield (file.symbol, file.interval, datetime.fromtimestamp(int(k[0]) / 1000, timezone.utc), *map(float, k[1:6]))


class KlineReader(DataSourceReader):
    def __init__(self, folder: str, glob: str) -> None:
        self.folder, self.glob = folder, glob
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  (Spark's name)
        """Takes those on symbol and interval; the others are left to Spark."""
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name not in ("symbol", "interval"):
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[name] = self.wanted[name] & values if name in self.wanted else values

    def partitions(self) -> Sequence[InputPartition]:
        return [f for f in _listed(self.folder, self.glob) if all(getattr(f, name) in values for name, values in self.wanted.items())]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(self.folder, partition) if isinstance(partition, KlineFile) else iter(())


class KlineStream(DataSourceStreamReader):
    def __init__(self, folder: str, glob: str) -> None:
        self.folder, self.glob = folder, glob

    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _listed(self.folder, self.glob)
        return {"changed": files[-1].changed, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        key = lambda o: (o["changed"], o["path"])
        return [f for f in _listed(self.folder, self.glob) if key(start) < (f.changed, f.path) <= key(end)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _rows(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class Klines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return SCHEMA

    def _where(self) -> tuple[str, str]:
        if "path" not in self.options:
            raise ValueError("klines are read from a path")
        return self.options["path"], self.options.get("glob", "*.json")

    def reader(self, schema: StructType) -> DataSourceReader:
        return KlineReader(*self._where())

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return KlineStream(*self._where())


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Klines)
