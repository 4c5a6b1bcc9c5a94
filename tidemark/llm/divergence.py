"""Source divergence audit: how far the words of each source of a language are from those of the others.

Each task counts, for (language, term), the documents that have the term, in a count-min table of fixed size; the tables are added up,
and a term whose sum stays below the least number of documents is impossible: it never leaves its task again. What survives is counted
exactly and held against the exact least number, so that the result depends on no hash. Sources then meet only in terms that both
have: what the other terms add to a pair's distance follows from either source's own terms.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize
from .runs import coded, lowered, name_hashes, runs, salted
from .sketch import SCHEMA, Counts, merged
from .text import chunks

#: Terms are runs of letters A-Z, in either case, and of whatever lies outside ASCII.
LETTERS = lowered(bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
#: The table: two rows of 2**21 slots, 4 MB a task and 512 KB broadcast.
ROWS, BITS = 2, 21
#: Rows that a task gathers before it adds them up.
GATHER = 400_000
SCALE, PRIOR = 1_000_000_000, 5
#: Tasks that share a language's pairs of sources.
DEALT = 32


def _terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Distinct terms of each text: (row of the batch, place of the term, occurrences), the terms and their hashes."""
    offsets, _, words = runs(batch.column("text"), LETTERS)
    place, known, hashes = coded(words)
    row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
    pair, n = np.unique(row * max(1, len(known)) + place, return_counts=True)
    return pair // max(1, len(known)), pair % max(1, len(known)), n, known, hashes


def _sketcher(rows: int, bits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Counts(rows, bits)
        for batch in chunks(batches, "text"):
            row, place, _, _, hashes = _terms(batch)
            key = salted(hashes[place], name_hashes(batch.column("lang"))[row])
            for r in range(rows):
                table.add(r, key)
        some = list(table.blocks())
        for a in range(0, len(some), 512):
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some[a : a + 512]], pa.int32()), pa.array([v for _, v in some[a : a + 512]], pa.binary())], names=["slots", "counts"])

    return run


def _added(tables: list[pa.Table]) -> pa.Table:
    """Rows of equal language, source and term as one."""
    t = pa.concat_tables(tables).unify_dictionaries()
    return t.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["lang", "source", "term", "n", "docs"])


def _plain(table: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from table.to_batches(max_chunksize=50_000)


def _counter(reached: Broadcast, rows: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, size = reached.value, [], 0
        for batch in chunks(batches, "text"):
            row, place, n, known, hashes = _terms(batch)
            key = salted(hashes[place], name_hashes(batch.column("lang"))[row])
            ok = np.ones(len(key), bool)
            for r in range(rows):
                ok &= bits.passes(r, key)
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            group = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(zero_copy_only=False)
            cell = group[row[ok]] * max(1, len(known)) + place[ok]
            cells, back = np.unique(cell, return_inverse=True)
            group, place = cells // max(1, len(known)), cells % max(1, len(known))
            held.append(
                pa.table(
                    {
                        "lang": lang.dictionary.take(pa.array(group // max(1, len(source.dictionary)))),
                        "source": source.dictionary.take(pa.array(group % max(1, len(source.dictionary)))),
                        "term": known.take(pa.array(place)),
                        "n": pa.array(np.bincount(back, n[ok], len(cells)).astype(np.int64)),
                        "docs": pa.array(np.bincount(back, minlength=len(cells)).astype(np.int64)),
                    }
                )
            )
            size += len(cells)
            if size > GATHER:
                held = [_added(held)]
                size = held[0].num_rows
                if size > GATHER // 2:
                    yield from _plain(held[0])
                    held, size = [], 0
        if held:
            yield from _plain(_added(held))

    return run


def _big(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(28,0)")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1e9 (count + 5) / (total + 5 kept)), exact for any counts; null where nothing is kept."""
    above, below = _big((count + PRIOR).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")), _big(total + PRIOR * kept)
    held = F.struct(above.alias("x"), F.when(below > 0, below).alias("y"))
    return F.lit(1).cast("long") + F.transform(F.array(held), lambda s: F.call_function("div", s["x"], s["y"]))[0]


def kept_cells(docs: DataFrame, least: int = 30, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """(lang, source, term, n, all_n): occurrences in the source and in the language, of terms in at least `least` of its documents."""
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    reached = merged(docs.mapInArrow(_sketcher(rows, bits), SCHEMA), rows, bits, least)
    some = docs.mapInArrow(_counter(reached, rows), "lang string, source string, term string, n long, docs long")
    exact = some.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    every = exact.withColumns({"in_docs": F.sum("docs").over(w), "all_n": F.sum("n").over(w)})
    return every.where(F.col("in_docs") >= least).select("lang", "source", "term", "n", "all_n")


def audit(docs: DataFrame, least: int = 30, top: int = 50, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has each other source of the language, part `term` the group's `top` own terms.

    docs: (text, lang, source); null in any of them is ''; other columns are left alone, and repeated rows count as often as they are
    there. A group without kept terms is there with all its pairs; a language with one source has no pairs; where no term is kept all
    values are 0; no rows without documents. Ties are ranked by the item's bytes.
    """
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    cells = materialize(kept_cells(docs, least, rows, bits), "cells")
    in_lang = cells.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("all_total"))
    in_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    known = groups.join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left")
    known = known.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "kept", "all_total")))
    known = materialize(known.withColumn("base", _share(zero, F.col("total"), F.col("kept"))), "groups")
    shares = cells.join(known, ["lang", "source"]).select("lang", "source", "term", "base", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), _share(F.col("all_n"), F.col("all_total"), F.col("kept")).alias("q"))
    shares = materialize(shares, "shares")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    pairs = _pairs(known, shares).withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)


def _pairs(known: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, part, item, value): the sum of |p - q| over all kept terms, of both orders of each pair.

    With a source's base b, the share of a term that it lacks: all kept terms at |b - b'|, then what each source's own terms change,
    the other one lacking them, then what changes for the terms of both.
    """
    a, b = shares.alias("a"), shares.alias("b")
    pa_, pb, ba, bb = (F.col(c) for c in ("a.p", "b.p", "a.base", "b.base"))
    both = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    change = F.abs(pa_ - pb) - F.abs(pa_ - bb) - F.abs(ba - pb) + F.abs(ba - bb)
    both = both.groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item")).agg(F.sum(change).alias("shared"))
    # terms of a source by share: how many, and at which share
    steps = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "k")).alias("steps"), F.sum("k").alias("own"), F.sum(F.col("p") * F.col("k")).alias("mass"))
    each = known.join(steps, ["lang", "source"], "left").select("lang", "source", "kept", F.coalesce("base", F.lit(0)).alias("base"), "steps", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("mass", F.lit(0)).alias("mass"))
    salt = F.pmod(F.xxhash64("source"), F.lit(DEALT)).cast("int")
    one = each.withColumn("salt", salt).alias("a")
    other = each.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))).alias("b")
    met = one.join(other, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.source") < F.col("b.source")))
    apart = F.abs(F.col("a.base") - F.col("b.base"))

    def alone(x: str, y: str) -> Column:
        """What the terms of x change where y lacks them."""
        floor = F.col(f"{y}.base")
        below = F.aggregate(F.filter(F.coalesce(f"{x}.steps", F.expr("array()")), lambda s: s["p"] < floor), F.lit(0).cast("long"), lambda t, s: t + s["k"] * (floor - s["p"]))
        return F.col(f"{x}.mass") - F.col(f"{x}.own") * (floor + apart) + 2 * below

    plain = met.select(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item"), (F.col("a.kept") * apart + alone("a", "b") + alone("b", "a")).alias("plain"))
    found = plain.join(both, ["lang", "source", "item"], "left").select("lang", "source", "item", (F.col("plain") + F.coalesce("shared", F.lit(0))).alias("value"))
    ends = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return found.select("lang", ends.alias("e"), "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
