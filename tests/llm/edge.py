"""A small table with every odd case, and the plain versions that operators are held against."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, component long, a long, b long, copy int, bucket long, chain long, digest string, score double, kept boolean"

PASSAGE = "the quick brown fox jumps over the lazy dog while seven wise men walk along the river bank and count the stars of night "
LONG = " ".join(f"w{k % 977} x{k}" for k in range(20_000))


def rows() -> list[tuple]:
    """doc_id, text, lang, source: nulls in each, empty and blank and very long texts, copies, near copies and a repeated row."""
    base = [
        (1, PASSAGE * 3, "en", "s1"),
        (2, PASSAGE * 3, "en", "s2"),
        (3, PASSAGE * 3 + "and more", "en", "s1"),
        (4, None, "en", "s1"),
        (5, "", "en", None),
        (6, " \t\n\x0b\x0c\r ", "fr", "s3"),
        (7, "one", None, "s1"),
        (8, "One", "en", "s1"),
        (9, LONG, "en", "s1"),
        (10, LONG + " tail", "en", "s1"),
        (11, "le chat est sur la table et le chien est dans le jardin\nle chat est sur la table", "fr", "s2"),
        (11, "le chat est sur la table et le chien est dans le jardin\nle chat est sur la table", "fr", "s2"),
        (12, "\U0001f600 ß É é don't!!", "de", "s3"),
        (13, "12 34 !!", "de", "s3"),
        (None, "no id here but some words", "en", "s1"),
        (None, None, None, None),
        (-5, "negative id with words of its own", "en", "s4"),
    ]
    return [(k, t, lang, source, None if t is None else len(t), 7, "key", 1, 2, 3, 4, 5, 6, "d", 0.5, True) for k, t, lang, source in base]


def frame(spark, some: list[tuple] | None = None):  # noqa: ANN001, ANN201
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def empty(spark):  # noqa: ANN001, ANN201
    return spark.createDataFrame([], SCHEMA)


def words(text: str | None) -> list[str]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0d]+", low)


def shingles(text: str | None, n: int) -> set:
    w = words(text)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


class Union:
    """Groups of numbers, each named by its smallest."""

    def __init__(self, items) -> None:  # noqa: ANN001
        self.up = {x: x for x in items}

    def find(self, x):  # noqa: ANN001, ANN201
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, x, y) -> None:  # noqa: ANN001
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def similar(x: set, y: set, percent: int = 80) -> bool:
    both = len(x & y)
    return bool(x and y) and 100 * both >= percent * (len(x) + len(y) - both)


def components(docs: list[tuple], n: int, percent: int = 80) -> dict:
    """doc_id to (set size, smallest id reachable) of (doc_id, text) with ids that differ."""
    sets = {k: shingles(t, n) for k, t in docs}
    groups, ids = Union(sets), sorted(sets)
    for i, x in enumerate(ids):
        for y in ids[i + 1 :]:
            if similar(sets[x], sets[y], percent):
                groups.join(x, y)
    return {k: (len(s), groups.find(k)) for k, s in sets.items()}
