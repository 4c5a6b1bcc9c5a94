"""Delta-maintained token counts: additive totals by source, language and tokenizer version.

A batch is a table of signed changes: an insert adds a document and its tokens, a delete takes both away, and a revised count
takes the old count away and adds the new one. A batch is summed by key before anything moves and is written once, under its own
name; a second commit of the same name changes nothing. Totals are the sum of the committed batches' deltas, so that they never
have to be counted anew, whatever the order of the batches; and what was committed can be summed up into one table now and then.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ._shared import delete, hadoop_fs
from .text import WordwiseTokenizer, chunks

KEYS = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long, batches long"

#: Tokenizer versions whose counts SQL can express too: runs of anything but ASCII white space; and runs of ASCII letters and
#: digits or of other characters that aren't ASCII white space.
VERSIONS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[0-9A-Za-z]+|[^0-9A-Za-z\x20\x09-\x0D]+"}


def count_tokens(text: Column, version: str) -> Column:
    """Tokens of a text under a version; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(VERSIONS[version])), F.lit(0)).cast("long")


def with_token_counts(docs: DataFrame, tokenizer: str, name: str, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, and in the column `name` how many tokens the tokenizer of that file makes of a text; 0 for null."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordwiseTokenizer.at(tokenizer)
        for batch in chunks(batches, text_col):
            ends, _ = encoder.encode(batch.column(text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(ends), pa.int64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def changes(rows: DataFrame, sign: int, tokens: Column, tokenizer: Column) -> DataFrame:
    """Signed changes of (source, lang) rows: +1 inserts, -1 deletes. Null sources and languages are keys of their own."""
    return rows.select(
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), tokenizer.cast("string").alias("tokenizer"), F.lit(sign).cast("long").alias("documents"), (tokens * sign).cast("long").alias("tokens")
    )


def revisions(rows: DataFrame, old: Column, new: Column, tokenizer: Column) -> DataFrame:
    """Changes of rows whose count under a version was `old` and is `new`: no document comes or goes."""
    return rows.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), tokenizer.cast("string").alias("tokenizer"), F.lit(0).cast("long").alias("documents"), (new - old).cast("long").alias("tokens"))


class Ledger:
    """Committed batches in a folder of the shared file system.

    A batch is written under a name of its own attempt, and committed by the one small file in `committed` that bears the batch's
    name and must not exist before: of two commits of one name, at the same time too, the first counts, and one that died before has no effect.
    The file names the table; should its writer die before that is written down, the first whole table of that batch counts.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _names(self, what: str) -> list[str]:
        fs, root = hadoop_fs(self.spark, f"{self.folder}/{what}")
        return sorted(x.getPath().getName() for x in fs.listStatus(root)) if fs.exists(root) else []

    def _create(self, path: str, content: str) -> bool:
        """A new file; False if there is one."""
        fs, at = hadoop_fs(self.spark, path)
        fs.mkdirs(at.getParent())
        try:
            out = fs.create(at, False)
        except Py4JJavaError:
            if fs.exists(at):
                return False
            raise
        out.write(bytearray(content.encode()))
        out.close()
        return True

    def _lines(self, path: str) -> list[str]:
        fs, at = hadoop_fs(self.spark, path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode().split("\n")
        finally:
            stream.close()

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        return self._names("committed")

    def _write(self, name: str, deltas: DataFrame) -> str:
        table = f"{name}-{uuid.uuid4().hex}"
        summed = deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), F.lit(1).cast("long").alias("batches"))
        summed.where("documents != 0 or tokens != 0").write.parquet(f"{self.folder}/tables/{table}")
        return table

    def _settle(self, name: str, table: str) -> bool:
        if self._create(f"{self.folder}/committed/{name}", table):
            return True
        delete(self.spark, f"{self.folder}/tables/{table}")
        return False

    def commit(self, name: str, deltas: DataFrame) -> bool:
        """Adds a batch of changes; False, and no effect, if a batch of this name is committed."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", name):
            raise ValueError(f"a batch needs a name of letters, digits, dots and dashes, not {name!r}")
        if name in self.batches():
            return False
        return self._settle(name, self._write(name, deltas))

    def _table(self, name: str) -> str:
        table = self._lines(f"{self.folder}/committed/{name}")[0]
        if table:
            return table
        mark = re.compile(re.escape(name) + "-[0-9a-f]{32}")
        whole = lambda t: "_SUCCESS" in self._names(f"tables/{t}")
        return next(t for t in self._names("tables") if mark.fullmatch(t) and whole(t))

    def _tables(self) -> tuple[list[str], list[str]]:
        """Tables whose sum is the total, and the batches that they hold."""
        names = self.batches()
        turns = self._names("compacted")
        held = self._lines(f"{self.folder}/compacted/{turns[-1]}") if turns else []
        return [*held[:1], *(self._table(n) for n in names if n not in set(held[1:]))], names

    def compact(self) -> int:
        """Sums all committed batches up into one table, which totals read in place of theirs; how many. Batches' names stay taken."""
        tables, names = self._tables()
        turn = len(self._names("compacted"))
        table = f"sum.{turn}-{uuid.uuid4().hex}"
        self._summed(tables).write.parquet(f"{self.folder}/tables/{table}")
        if not self._create(f"{self.folder}/compacted/{turn:08d}", "\n".join([table, *names])):
            delete(self.spark, f"{self.folder}/tables/{table}")
            return 0
        return len(names)

    def _summed(self, tables: list[str]) -> DataFrame:
        if not tables:
            return self.spark.createDataFrame([], _SCHEMA)
        rows = self.spark.read.schema(_SCHEMA).parquet(*(f"{self.folder}/tables/{t}" for t in tables))
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("documents", "tokens", "batches")))

    def totals(self, keep_empty: bool = False) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens, batches: how many changed the key) over all committed batches."""
        total = self._summed(self._tables()[0])
        return total if keep_empty else total.where("documents != 0 or tokens != 0")
