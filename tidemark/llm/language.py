"""Language identification by rank-order profiles (Cavnar and Trenkle, "N-gram-based text categorization", 1994).

A profile is a list of the most frequent character n-grams, most frequent first. A text's distance to a language is the sum, over
the text's own profile, of how far each n-gram is out of its place in the language's; the nearest language is the prediction.
N-grams of 1 to 3 letters are taken within words, whose ends count as a letter; case and whatever isn't a letter are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import chunks

#: N-grams in a profile.
SIZE = 400
#: Bytes of text that are taken at once.
CHUNK = 1 << 19
#: What a text without letters is taken for.
UNKNOWN = "und"


@dataclass(frozen=True)
class Profiles:
    """For each language the codes of its n-grams in ascending order, and their ranks from 0."""

    languages: tuple[str, ...]
    codes: tuple[np.ndarray, ...]
    ranks: tuple[np.ndarray, ...]
    size: int = SIZE


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if "letters" not in _KEPT:
        _KEPT["letters"] = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _KEPT["letters"]


_KEPT: dict[str, np.ndarray] = {}


def grams(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n-grams of 1, 2 and 3 letters: the codes of those of all texts, and the number of the text that each is of."""
    listed = pc.utf8_lower(pc.fill_null(texts, "")).to_pylist()
    points = np.frombuffer("".join(f"\n{x}\n" for x in listed).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(x) + 2 for x in listed], np.int64)
    letter = _letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # what follows a word ends it and begins the next
    keep[np.cumsum(size) - size] = True  # and the mark before a text begins its first
    p, o, l = np.where(letter, points, 0)[keep].astype(np.uint64), np.repeat(np.arange(len(listed)), size)[keep], letter[keep]
    two = (o[:-1] == o[1:]) & (l[:-1] | l[1:])
    three = (o[:-2] == o[2:]) & l[1:-1]
    return [
        (p[l], o[l]),
        (((p[:-1] << np.uint64(21)) | p[1:])[two] | np.uint64(1 << 62), o[:-1][two]),
        (((p[:-2] << np.uint64(42)) | (p[1:-1] << np.uint64(21)) | p[2:])[three] | np.uint64(1 << 63), o[:-2][three]),
    ]


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in ascending order, and how many there are of each."""
    codes = np.sort(codes)
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.empty(0, np.int64)
    return codes[first], np.diff(first, append=len(codes))


def _counter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[str, int], int] = {}

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in total], pa.string()), pa.array([g for _, g in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["lang", "gram", "n"]
        )
        total.clear()
        return out

    for batch in chunks(batches, "text", CHUNK):
        languages = batch.column("lang").to_pylist()
        found = grams(batch.column("text"))
        names = sorted(set(languages))
        of = np.searchsorted(np.array(names, object), np.array(languages, object)) if len(names) > 1 else np.zeros(len(languages), np.int64)
        for (k, name), (codes, owners) in product(enumerate(names), found):
            known, n = _counted(codes[of[owners] == k])
            for g, c in zip(known.view(np.int64).tolist(), n.tolist(), strict=True):
                total[name, g] = total.get((name, g), 0) + c
        if len(total) > 500_000:
            yield flushed()
    yield flushed()


def learn(docs: DataFrame, lang: Column, text_col: str = "text", size: int = SIZE) -> Profiles:
    """Profiles of all languages named in `lang`, from the counts over every text of each (null languages and texts: unused).

    Only the profiles come to the driver: `size` n-grams a language. Ties go to the smaller code.
    """
    rows = docs.select(lang.cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(_counter, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # codes are numbers without a sign: those that a long shows as negative are the largest
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.col("gram") < 0, "gram"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= size).collect()
    names = tuple(sorted({r.lang for r in top}))
    codes, ranks = [], []
    for name in names:
        own = sorted((np.uint64(r.gram & (2**64 - 1)), r["rank"] - 1) for r in top if r.lang == name)
        codes.append(np.array([c for c, _ in own], np.uint64))
        ranks.append(np.array([k for _, k in own], np.int64))
    return Profiles(names, tuple(codes), tuple(ranks), size)


def classify(codes: np.ndarray, profiles: Profiles) -> tuple[str, float]:
    """The nearest language and 1 minus its distance as a share of the largest possible one."""
    if not len(codes) or not profiles.languages:
        return UNKNOWN, 0.0
    found, n = _counted(codes)
    top = found[np.lexsort((found, -n))[: profiles.size]]
    place, best = np.arange(len(top)), (UNKNOWN, -1.0)
    for name, known, ranks in zip(profiles.languages, profiles.codes, profiles.ranks, strict=True):
        at = np.minimum(np.searchsorted(known, top), len(known) - 1)
        away = np.where(known[at] == top, np.minimum(np.abs(ranks[at] - place), profiles.size), profiles.size)
        score = 1.0 - float(away.sum()) / (profiles.size * len(top))
        if score > best[1]:
            best = (name, score)
    return best


def _predictor(profiles: Profiles) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__tm_text", CHUNK):
            found = grams(batch.column("__tm_text"))
            cuts = [np.searchsorted(owners, np.arange(batch.num_rows + 1)).tolist() for _, owners in found]
            got = [classify(np.concatenate([codes[c[k] : c[k + 1]] for (codes, _), c in zip(found, cuts, strict=True)]), profiles) for k in range(batch.num_rows)]
            kept = [batch.column(c) for c in batch.schema.names if c != "__tm_text"]
            names = [c for c in batch.schema.names if c != "__tm_text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, profiles: Profiles, keep: list[str | Column], text_col: str = "text") -> DataFrame:
    """The columns `keep` of each row, lang_pred and score (0 to 1).

    A null text and one without a letter are `und` with score 0, as are all if no language was learned. Of languages at the same
    distance the first in code point order wins. Equal texts get equal results. An empty table gives an empty table.
    """
    rows = docs.select(*keep, F.col(text_col).alias("__tm_text"))
    schema = rows.drop("__tm_text").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(_predictor(profiles), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is one that nothing is learned from: a quarter of all ids, and rows without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = SIZE) -> DataFrame:
    """Learns from the labelled rows that aren't held out and predicts all: (id_col, held_out, lang_pred, score)."""
    profiles = learn(docs.where(~held_out(id_col)), F.col(lang_col), text_col, size)
    return predict(docs, profiles, [F.col(id_col), held_out(id_col).alias("held_out")], text_col)
