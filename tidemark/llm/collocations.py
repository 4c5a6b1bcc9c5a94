"""Phrase collocations: n-grams counted by suffix arrays over word ids, joined to their parts' counts, scored and pruned.

A shard is a few megabytes of texts. Its words become ids, pieces end with the id 0, and numpy sorts all suffixes by their first 1, 2, 4
and 8 ids (prefix doubling). Runs of suffixes that share n words (LCP intervals) are the shard's n-grams with their counts, which are
added up by language and phrase.

Most n-grams of a shard are rare, and all of them would have to be shuffled. So a first pass adds words, pairs and triples to count-min
tables, a row for each length; an n-gram whose words, pairs or triples can't have reached the least count can't
have reached it either, and never leaves its shard. What passes is counted exactly: the result depends on no hash. A row has 2**30 slots, of which
a task sends those that it has seen: tables that fit a task are full at a few GB of text, and then let everything pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize
from .runs import coded, lowered, name_hashes, runs, salted
from .sketch import SCHEMA, Tally, tallied
from .text import chunks, feature_hashes, release

BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
WORDS = lowered(BREAKS + b"\x20\x09")
#: The tables: a row each for words, pairs and triples, 2**30 slots.
ROWS, BITS = 3, 30
UNKNOWN = "und"
#: Bytes of text of a shard; rows that a task gathers before it adds them up; phrases whose texts are made at once.
SHARD_BYTES, GATHER, AT_ONCE = 8 << 20, 800_000, 200_000
LONGEST = 5
#: Phrases of a language, as dealt to tasks before the last ranking.
DEALT = 64


class Shard:
    """The words of some texts: ids from 1, a 0 after each piece; ids of different languages differ."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        offsets, piece, words = runs(batch.column("text"), WORDS, BREAKS)
        place, self.known, hashes = coded(words)
        lang = batch.column("lang").dictionary_encode()
        self.langs = lang.dictionary
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        of = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        ids, place = np.unique(place * max(1, len(self.langs)) + of, return_inverse=True)
        self.word, self.lang = ids // max(1, len(self.langs)), ids % max(1, len(self.langs))
        self.hashes = np.concatenate((np.zeros(1, np.uint64), salted(hashes[self.word], name_hashes(self.langs)[self.lang]))) if len(ids) else np.zeros(1, np.uint64)
        new = np.ones(len(place), np.int64)
        new[1:] = piece[1:] != piece[:-1]
        at = np.arange(len(place)) + np.cumsum(new)  # a 0 before each piece
        self.ids = np.zeros(len(place) + int(new.sum()) + 1 + LONGEST, np.int64)
        self.ids[at] = place + 1
        self.n = len(self.ids) - LONGEST

    def totals(self) -> tuple[list[str], list[int]]:
        """Words of each language."""
        n = np.bincount(self.lang, np.bincount(self.ids, minlength=len(self.lang) + 1)[1:], len(self.langs)) if len(self.lang) else np.zeros(0)
        return self.langs.to_pylist(), n.astype(np.int64).tolist()

    def keys(self, n: int) -> np.ndarray:
        """A hash of the n words from each place on; only of use where all of them are in the piece."""
        h = self.hashes[self.ids[: self.n]]
        for k in range(1, n):
            h = salted(h, self.hashes[self.ids[k : k + self.n]])
        return h

    def lengths(self, reached: Broadcast | None = None) -> np.ndarray:
        """How many words from each place on, LONGEST at most, can be a phrase that has reached the least count."""
        ids, n = self.ids, self.n
        inside = np.zeros((LONGEST, n), bool)  # k + 1 words from here on are in the piece
        inside[0] = ids[:n] > 0
        for k in range(1, LONGEST):
            inside[k] = inside[k - 1] & (ids[k : k + n] > 0)
        if reached is not None:
            bits = reached.value
            ok = []
            for r in range(ROWS):
                ok.append(np.zeros(n + LONGEST, bool))
                some = np.flatnonzero(inside[r] if not r else inside[r] & ok[r - 1][:n] & ok[r - 1][1 : n + 1])
                ok[r][some] = bits.passes(r, self.keys(r + 1)[some])
            inside[:ROWS] &= [x[:n] for x in ok]
            for k in range(ROWS, LONGEST):
                inside[k] &= inside[k - 1] & ok[ROWS - 1][k - ROWS + 1 : k - ROWS + 1 + n]
        return inside.sum(axis=0)

    def suffixes(self, at: np.ndarray) -> np.ndarray:
        """The places in the order of the 8 ids from there on, by prefix doubling over all places that they reach."""
        rank, width = self.ids, 1
        while width < LONGEST:
            ahead = np.zeros_like(rank)
            ahead[:-width] = rank[width:]
            key = rank * (int(rank.max(initial=0)) + 1) + ahead
            if 2 * width >= LONGEST:
                return at[np.argsort(key[at])]
            order = np.argsort(key)
            new = np.ones(len(key), np.int64)
            new[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty_like(key)
            rank[order] = np.cumsum(new)
            width *= 2
        return at

    def phrases(self, length: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, a place of each phrase of n words, its count): LCP intervals of the suffixes, as far as lengths allow."""
        order = self.suffixes(np.flatnonzero(length))
        if not len(order):
            return
        most = length[order]
        same = np.ones(len(order) - 1, bool)
        shared = np.zeros(len(order), np.int64)  # words shared with the suffix before
        for k in range(LONGEST):
            same &= self.ids[order[1:] + k] == self.ids[order[:-1] + k]
            shared[1:] += same
        for n in range(1, LONGEST + 1):
            first = (shared < n) & (most >= n)
            held = np.flatnonzero(most >= n)
            if len(held):
                begins = np.flatnonzero(first[held])
                yield n, order[held[begins]], np.diff(begins, append=len(held))

    def texts(self, n: int, at: np.ndarray) -> pa.Array:
        words = [self.known.take(pa.array(self.word[self.ids[at + k] - 1])) for k in range(n)]
        return pc.binary_join_element_wise(*words, " ") if n > 1 else words[0]


def _sketcher(bits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(ROWS, bits)
        for batch in chunks(batches, "text"):
            shard = Shard(batch)
            length = shard.lengths()
            for r in range(ROWS):
                tally.add(r, shard.keys(r + 1)[length > r])
            yield from tally.blocks()
        yield from tally.blocks(last=True)
        release()

    return run


def _added(tables: list[pa.Table]) -> pa.Table:
    """Counts of equal phrases of a language as one."""
    return pa.concat_tables(tables).group_by(["lang", "words", "phrase"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", "words", "phrase", "n"])


def _packs(table: pa.Table, parts: int) -> pa.RecordBatch:
    """A row for each part of phrases, by hash: lists of languages, words, phrases and counts."""
    table = table.combine_chunks()
    columns = [table.column(c).combine_chunks() for c in ("lang", "words", "phrase", "n")]
    key = salted(salted(feature_hashes(columns[2]), name_hashes(columns[0])), 1)
    part = (key % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    begins = np.flatnonzero(np.diff(part[order], prepend=-1))
    offsets = pa.array(np.append(begins, len(order)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, c.take(pa.array(order))) for c in columns]
    return pa.RecordBatch.from_arrays([pa.array(part[order[begins]].astype(np.int32)), *lists], names=["part", "lang", "words", "phrase", "n"])


def _counter(reached: Broadcast, parts: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's shards, their phrases added up before they leave it, as long as that makes fewer of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def gathered() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if sum(t.num_rows for t in held) > GATHER:
                held = [_added(held)]
                if held[0].num_rows > GATHER // 2:
                    yield _packs(held.pop(), parts)

        for batch in chunks(batches, "text", SHARD_BYTES):
            shard = Shard(batch)
            names, totals = shard.totals()
            held.append(pa.table([pa.array(names, pa.string()), pa.array([0] * len(names), pa.int32()), pa.array([""] * len(names), pa.string()), pa.array(totals, pa.int64())], names=["lang", "words", "phrase", "n"]))
            for n, every, counts in shard.phrases(shard.lengths(reached)):
                for a in range(0, len(every), AT_ONCE):
                    at, count = every[a : a + AT_ONCE], counts[a : a + AT_ONCE]
                    lang = shard.langs.take(pa.array(shard.lang[shard.ids[at] - 1]))
                    held.append(pa.table([lang, pa.array(np.full(len(at), n, np.int32)), shard.texts(n, at), pa.array(count)], names=["lang", "words", "phrase", "n"]))
                    yield from gathered()
        if held:
            yield _packs(_added(held), parts)
        held = []
        release()

    return run


def _total(least: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs in order of their part: those of a part added up as they come. What stays below `least` ends here."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size, now = 0, -1

        def sums() -> Iterator[pa.RecordBatch]:
            every = _added(held)
            held.clear()
            yield from every.filter(pc.or_(pc.equal(every.column("words"), 0), pc.greater_equal(every.column("n"), least))).to_batches(max_chunksize=50_000)

        for batch in batches:
            part = batch.column("part").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if part[a] != now:
                    if held:
                        yield from sums()
                    size, now = 0, part[a]
                held.append(pa.table({c: batch.column(c).slice(a, b - a).flatten() for c in ("lang", "words", "phrase", "n")}))
                size += held[-1].num_rows
                if size > 2 * GATHER:
                    held[:] = [_added(held)]
                    size = held[0].num_rows - GATHER  # so that what is distinct isn't added up again at once
        if held:
            yield from sums()
        release()

    return run


def phrase_counts(docs: DataFrame, least: int = 100, bits: int = BITS) -> DataFrame:
    """(lang, words, phrase, n): phrases of 1 to 5 words that occur `least` times or more; and with 0 words all words of the language.

    Tasks' counts travel in packs, by hash of language and phrase, to the task that adds them up: four packs a task for each partition of a
    shuffle, or of the input if those are more, so that what is added up at once doesn't grow with the input.
    """
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    reached = tallied(docs.mapInArrow(_sketcher(bits), SCHEMA), ROWS, bits, least)
    parts = 4 * max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    packs = docs.mapInArrow(_counter(reached, parts), "part int, lang array<string>, words array<int>, phrase array<string>, n array<long>")
    return packs.repartition("part").sortWithinPartitions("part").mapInArrow(_total(least), "lang string, words int, phrase string, n long")


def collocations(docs: DataFrame, least: int = 100, percent: int = 100, top: int = 2000, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to 5 words.

    A phrase that occurs a times is cut after its first k words, which occur l times, the others r times; the cut with the least
    floor(1000 a n / (l r)) counts, of equal ones the first. Phrases inside a longer one that has at least `percent` % of their count are left
    out. docs: (text, lang); null text is empty, null lang `und` (as is the language of that name); words end with their text; repeated
    rows count as often as they are there; without phrases there are no rows. Ties: more often, then the phrase's bytes.
    """
    if not 0 < least <= 255:
        raise ValueError("least is 1 to 255")
    every = materialize(phrase_counts(docs, least, bits), "phrases")
    total = every.where("words = 0").select("lang", F.col("n").alias("all_n"))
    known = every.where("words > 0").select("lang", "words", "phrase", "n")
    long = known.where("words > 1").withColumn("parts", F.split("phrase", " "))
    # of what holds a phrase with so much of its count, a part that is one word longer than the phrase does too
    inner = F.array(*(F.array_join(F.slice("parts", start, F.col("words") - 1), " ") for start in (1, 2)))
    covered = long.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "n")
    covered = covered.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    left = long.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("n")))
    cuts = left.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.expr("transform(sequence(1, words - 1), k -> struct(k, array_join(slice(parts, 1, k), ' ') AS first, array_join(slice(parts, k + 1, words - k), ' ') AS rest))")).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "c.k", "c.first", "c.rest")
    part = known.select("lang", "phrase", "n")
    cuts = cuts.join(part.toDF("lang", "first", "l"), ["lang", "first"]).join(part.toDF("lang", "rest", "r"), ["lang", "rest"]).join(total, "lang")
    big = lambda c: F.col(c).cast("decimal(19,0)")
    above = (big("a") * big("all_n")) * F.lit(1000).cast("decimal(4,0)")
    score = F.call_function("div", above, big("l") * big("r"))
    scored = cuts.select("lang", "phrase", "a", "k", "l", "r", F.col("all_n").alias("n"), score.alias("score"))
    one = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m"))
    one = one.select("lang", "phrase", "m.a", "m.l", "m.r", "m.n", "m.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = one.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    some = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
    last = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return last.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

