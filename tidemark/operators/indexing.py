"""Indexers as table functions of SQL: they take a chat's messages in order and return rows to index.

    SELECT * FROM message_chunks(TABLE(SELECT chat, id, ts, author, text, reply_to FROM m) PARTITION BY chat ORDER BY (ts, id))

Spark deals and sorts the rows; a function holds what it knows of one chat's open chunk, and gives the last chunk at the chat's end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

STOPS = (r"^#новая тема", r"^\[ANN\]", r"^Summary:")


class Indexer:
    """The base: rows of a partition in order; `begins` says whether a row ends what is open, `closed` makes the row to index."""

    def __init__(self) -> None:
        self.open: list[Row] = []
        self.number = 0

    def begins(self, row: Row) -> bool:
        raise NotImplementedError

    def closed(self, rows: list[Row], number: int) -> tuple:
        raise NotImplementedError

    def eval(self, row: Row) -> Iterator[tuple]:
        if self.open and self.begins(row):
            yield self.closed(self.open, self.number)
            self.open, self.number = [], self.number + 1
        self.open.append(row)

    def terminate(self) -> Iterator[tuple]:
        if self.open:
            yield self.closed(self.open, self.number)


class ChunkIndexer(Indexer):
    """A row a chunk of a chat's messages (chat, id, ts, author, text, reply_to), by the rules of `sessions.chunks` for ids that don't repeat."""

    most_tokens, gap, reply_gap = 4000, timedelta(minutes=10), timedelta(minutes=120)

    def __init__(self) -> None:
        super().__init__()
        self.stops = [re.compile(p, re.IGNORECASE) for p in STOPS]

    @staticmethod
    def tokens(text: str | None) -> int:
        return max(1, len(text or "") // 4)

    def begins(self, row: Row) -> bool:
        if any(p.search(row["text"] or "") for p in self.stops) or sum(self.tokens(r["text"]) for r in self.open) + self.tokens(row["text"]) > self.most_tokens:
            return True
        reply = row["reply_to"] is not None and any(r["id"] == row["reply_to"] for r in self.open)
        last: datetime = self.open[-1]["ts"]
        return row["ts"] - last > (self.reply_gap if reply else self.gap)

    def closed(self, rows: list[Row], number: int) -> tuple:
        return rows[0]["chat"], number, rows[0]["ts"], rows[-1]["ts"], [r["id"] for r in rows], "\n".join(r["text"] for r in rows if r["text"])


def register(spark: SparkSession, name: str = "message_chunks", most_tokens: int = 4000, gap_minutes: int = 10, reply_gap_minutes: int = 120) -> None:
    """Makes `name` a table function of the session, with limits of its own. The chunk that is open is held in memory: at most about `most_tokens` tokens."""

    class Sized(ChunkIndexer):
        pass

    Sized.most_tokens, Sized.gap, Sized.reply_gap = most_tokens, timedelta(minutes=gap_minutes), timedelta(minutes=reply_gap_minutes)
    spark.udtf.register(name, udtf(Sized, returnType="chat string, chunk_no int, start timestamp_ntz, end timestamp_ntz, ids array<bigint>, text string"))
