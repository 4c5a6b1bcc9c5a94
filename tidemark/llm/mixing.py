"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is how often each of its documents should be taken. The whole part is taken; the rest is a
copy probability, and probabilities are settled in pairs: mass moves between two documents, weighed by their sizes, until one of
them is 0 or 1, with chances that leave both expectations as they were. So the taken size of a source stays what it was, and
expected copies are exact. Buckets settle all but one document of each source; what they leave is settled in a tree of groups.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, unfolded

#: Documents in a bucket, about, and groups that meet in one of the next level.
BUCKET, FAN_IN = 16_384, 64
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, take the weights in turn and share the total size by weight, but none gets more than
    `most` times its size: what is above goes to the others by weight, again and again. In closed form: with the sources in order of
    size by weight, the first whose share of what the smaller ones leave is within its bound sets the level for it and all after it.
    A source of size 0 has target 0. Only sources are ordered here, after their sizes were added up.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighed = total.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    bound = F.col("source_size") * most
    in_order = Window.orderBy(bound / F.col("weight"), F.col("source").asc_nulls_first())
    upto = in_order.rowsBetween(Window.unboundedPreceding, -1)
    rest = in_order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum(bound).over(upto), F.lit(0.0))
    leveled = weighed.withColumn("level", left / F.sum("weight").over(rest)).withColumn("place", F.row_number().over(in_order))
    leveled = leveled.withColumn("fits", F.when(F.col("level") * F.col("weight") <= bound, F.struct("place", "level")))
    level = F.min("fits").over(whole)
    target = F.when(F.coalesce(F.col("place") < level["place"], F.lit(True)), bound).otherwise(level["level"] * F.col("weight"))
    return leveled.withColumn("target", target.cast("double")).select("source", "source_size", "target")


def _uniform(seed: int, a: object, b: object) -> float:
    return xxhash.xxh3_64_intdigest(f"{seed}|{a}|{b}".encode()) / 2.0**64


def _evened(k: int, to: float, share: list[float], size: list[int], loose: list[int]) -> tuple[float, dict[int, float]]:
    """What stays owed if document k is rounded to `to`, and the documents that change with it.

    What the rounding adds or takes goes by other documents that were open and have the opposite value, larger ones first, as long
    as they fit.
    """
    owed, changed = (share[k] - to) * size[k], {k: to}
    for other in sorted(loose, key=lambda j: (-size[j], j)):
        if other != k and owed >= size[other] and share[other] == 0.0:
            changed[other], owed = 1.0, owed - size[other]
        elif other != k and -owed >= size[other] and share[other] == 1.0:
            changed[other], owed = 0.0, owed + size[other]
    return abs(owed), changed


def _round_last(k: int, chance: float, share: list[float], size: list[int], loose: list[int]) -> None:
    """Rounds a source's last open document the way that owes less in the end; by chance if neither does."""
    down, up = _evened(k, 0.0, share, size, loose), _evened(k, 1.0, share, size, loose)
    for j, x in (down if down[0] < up[0] or down[0] == up[0] and chance >= share[k] else up)[1].items():
        share[j] = x


def _settle(seed: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Settles a group's documents, source by source; one of each source may stay open, unless this is the last level."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["source", "size", "name"], ascending=[True, False, True], na_position="last", ignore_index=True)
        share, size = group["share"].tolist(), group["size"].tolist()
        ids, source = group["name"].tolist(), group["source"].tolist()
        opened = [False] * len(share)
        loose: dict[object, list[int]] = {}
        source_of = lambda k: None if pd.isna(source[k]) else source[k]
        for k in range(len(share)):
            if size[k] and 0.0 < share[k] < 1.0:
                loose.setdefault(source_of(k), []).append(k)
        open_ = -1
        for k in range(len(share) + 1):
            if k == len(share) or (open_ >= 0 and source[k] != source[open_] and not (pd.isna(source[k]) and pd.isna(source[open_]))):
                if open_ >= 0:
                    if last:
                        _round_last(open_, _uniform(seed, ids[open_], size[open_]), share, size, loose[source_of(open_)])
                    else:
                        opened[open_] = True
                open_ = -1
                if k == len(share):
                    break
            if size[k] == 0 or share[k] in (0.0, 1.0):
                share[k] = round(share[k])
                continue
            if open_ < 0:
                open_ = k
                continue
            a, b, p, q = float(size[open_]), float(size[k]), share[open_], share[k]
            up = min(a * (1 - p), b * q)  # mass that may move to the open one
            down = min(a * p, b * (1 - q))  # and from it
            if _uniform(seed, f"{ids[open_]}|{size[open_]}", f"{ids[k]}|{size[k]}") * (up + down) < down:
                full, p, q = a * (1 - p) <= b * q, p + up / a, q - up / b
                p, q = (1.0, q) if full else (p, 0.0)
            else:
                gone, p, q = a * p <= b * (1 - q), p - down / a, q + down / b
                p, q = (0.0, q) if gone else (p, 1.0)
            share[open_], share[k] = p, q
            if p in (0.0, 1.0):
                open_ = k if 0.0 < q < 1.0 else -1
        group["share"], group["open"] = share, opened
        return group

    return run


def _mixed(rows: DataFrame, weights: tuple[float, ...], most: float, seed: int) -> DataFrame:
    """(doc_id, source, size, n, source_size, target, base, more) of rows (doc_id, source, size).

    Rows that are equal in all three count as one, which stands for n documents: `base` copies of each, and one more of `more` of them.
    The first documents of such a group are rounded up as far as the sum of their shares is whole; what is left of it is settled with the other rows.
    """
    rows = materialize(rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "sizes")
    targets = materialize(source_targets(rows.select("source", (F.col("size") * F.col("n")).alias("size")), weights, most), "targets")
    each = rows.join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    each = each.withColumn("rate", rate).withColumn("base", F.floor("rate").cast("long"))
    due = F.when(F.col("size") > 0, (F.col("rate") - F.col("base")) * F.col("n")).otherwise(F.lit(0.0))
    each = each.withColumn("whole", F.floor(due).cast("long")).withColumn("share", due - F.col("whole")).drop("rate")
    # as text, so that a null id doesn't make the others floating-point numbers in pandas
    each = each.withColumn("name", F.col("doc_id").cast("string")).drop("doc_id")
    buckets = max(1, -(-rows.count() // BUCKET))
    each = each.withColumn("bucket", F.pmod(F.xxhash64("name", "source", "size", F.lit(seed)), F.lit(buckets)))
    names = "source string, size long, n long, source_size long, target double, base long, whole long, share double, name string, bucket long"
    level, key, settled = each, ["bucket"], []
    while True:
        last = buckets == 1
        done = level.groupBy(*key).applyInPandas(_settle(seed + len(settled), last), names + ", open boolean")
        done = materialize(done, "settled")
        settled.append(done.where("not open"))
        if last:
            break
        buckets = -(-buckets // FAN_IN)
        level = done.where("open").drop("open").withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
        key = ["source", "bucket"]
    out = reduce(DataFrame.union, settled).withColumn("doc_id", F.col("name").cast("long"))
    return out.select("doc_id", "source", "size", "n", "source_size", "target", "base", (F.col("whole") + F.round("share").cast("long")).alias("more"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: float = 3.0, seed: int = 0) -> DataFrame:
    """How much of each document the mix takes: (id_col, size, source_size, source, target, copies, taken = copies * size).

    A document's copies are the whole or the next whole number of its source's target by size, so never above `most`. The taken
    words of a source differ from its target by less than one document. Equal seeds give equal results. Null texts and texts of white
    space have size 0 and no copies beyond the whole ones, of nothing. The null source is a source; rows that repeat an id are
    documents of their own, of which those of one source and size may change places; null ids are such an id. Other columns are ignored.
    Empty tables give empty tables.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    found = _mixed(rows, tuple(weights), most, seed)
    kept = ["doc_id", "size", "source_size", "source", "target"]
    once = found.where("n = 1").select(*kept, (F.col("base") + F.col("more")).alias("copies"))
    parts = unfolded(found.where("n > 1"), F.col("n"), "k")
    again = parts.select(*kept, (F.col("base") + (F.col("k") <= F.col("more")).cast("long")).alias("copies"))
    out = once.union(again)
    return out.select(F.col("doc_id").alias(id_col), "size", "source_size", F.col("source").alias(source_col), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take(docs: DataFrame, text_col: str = "text", source_col: str = "source", **how: object) -> DataFrame:
    """The rows of `docs`, all columns, each as many times as the mix takes it (see `mix`).

    Rows are numbered in a written table and mixed by that number, so nothing depends on ids, which may be null or repeat.
    """
    held = materialize(docs.withColumn("__tm_row", F.monotonically_increasing_id()), "rows")
    copies = mix(held, "__tm_row", text_col, source_col, **how).where("copies > 0").select(F.col("__tm_row").alias("__tm_id"), "copies")
    many = held.join(copies, F.col("__tm_row") == F.col("__tm_id"))
    return many.withColumn("__tm_n", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*(held[c] for c in docs.columns))
