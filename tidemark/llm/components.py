"""Links between items that share keys, and the groups that links connect. Nothing of this size is collected."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import forget, materialize, settled
from .text import release

#: Of the keys and columns of some members, and the places of pairs of them: the places of those worth a check.
Compare = Callable[[np.ndarray, dict[str, pa.Array], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


#: Links that one task takes in (16 bytes each); more go through turns that are written.
TASK = 200_000


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, and the smallest node that each reaches."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    one, two = place[: len(a)], place[len(a) :]
    to = np.arange(len(nodes))
    while True:
        before = to.copy()
        np.minimum.at(to, one, before[two])
        np.minimum.at(to, two, before[one])
        while (to[to] != to).any():
            to = to[to]
        # a place's own label follows those of its members
        np.minimum.at(to, before, to.copy())
        if (to == before).all():
            return nodes, nodes[to]


def _in_one_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if columns:
        a, b = (np.concatenate(x) for x in zip(*columns, strict=True))
        nodes, to = least_reached(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(to, pa.int64())], names=["id", "to"])


def connected_components(links: DataFrame) -> DataFrame:
    """Each node of `links` (a, b) with the smallest node that it reaches: (id, component).

    Every turn each node moves to the least of itself and its neighbours, links are drawn anew between the places they moved
    to, and those inside one place go. The first turn compares ids, which ends stars around their smallest member at once;
    later turns compare hashes of a new seed, so that no chain takes more than logarithmically many turns in expectation.
    As soon as the links that are left fit one task, one task ends it. Self-links and repeated links are allowed. Nodes without links aren't returned.
    """
    live = materialize(links.where("a != b").select("a", "b").distinct(), "links")
    moves: list[DataFrame] = []
    for turn in count():
        few = live.count()
        if few == 0:
            forget(live)
            break
        if few <= TASK:
            moves.append(materialize(live.coalesce(1).mapInArrow(_in_one_task, "id long, to long"), "moves"))
            forget(live)
            break
        rank = (lambda x: F.lit(0).cast("long")) if turn == 0 else (lambda x, seed=turn: F.xxhash64(x, F.lit(seed)))
        both = live.select(F.col("a").alias("id"), F.col("b").alias("to")).union(live.select("b", "a"))
        least = both.groupBy("id").agg(F.min(F.struct(rank(F.col("to")).alias("rank"), "to")).alias("best"))
        own = F.struct(rank(F.col("id")).alias("rank"), F.col("id").alias("to"))
        move = materialize(least.select("id", F.least("best", own)["to"].alias("to")), "moves")
        moves.append(move)
        drawn = (
            live.join(move.withColumnRenamed("id", "a"), "a").select(F.col("to").alias("a"), "b")
            .join(move.withColumnRenamed("id", "b"), "b").select("a", F.col("to").alias("b"))
        )
        after = materialize(drawn.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        forget(live)
        live = after
    if not moves:
        return links.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    place = moves[-1]
    for move in reversed(moves[:-1]):
        then = place.select(F.col("id").alias("to"), F.col("to").alias("then"))
        place = move.join(then, "to", "left").select("id", F.coalesce("then", "to").alias("to"))
    if len(moves) == 1:
        return place.select("id", F.col("to").alias("component"))
    place = materialize(place, "places")
    named = place.groupBy("to").agg(F.min("id").alias("component"))
    return place.join(named, "to").select("id", "component")


#: Members of a key that are held against each other at once; larger keys are dealt into blocks of about so many.
BLOCK = 1024
#: So many keys of more than two members are broadcast (16 bytes each); more are joined by a shuffle.
FEW = 500_000


#: Pairs of places that are looked at together, about.
PAIRS = 1 << 20


def first_shared(lists: pa.ListArray, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a pair of places has no key in common before the one under which it meets. lists: all keys of each place, in order."""
    ends, values = lists.offsets.to_numpy().astype(np.int64), lists.flatten().to_numpy()
    ends = ends - ends[0]
    known, key = np.unique(values, return_inverse=True)
    held = np.repeat(np.arange(len(keys)), np.diff(ends)) * len(known) + key
    now = np.searchsorted(known, keys)
    out = np.ones(len(a), bool)
    for start in range(0, len(a), PAIRS // 16):
        x, y = a[start : start + PAIRS // 16], b[start : start + PAIRS // 16]
        many = ends[x + 1] - ends[x]
        pair = np.repeat(np.arange(len(x)), many)
        other = key[ends[x][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)]
        before = other < now[x][pair]
        pair, other = pair[before], other[before]
        want = y[pair] * len(known) + other
        out[start + pair[held[np.minimum(np.searchsorted(held, want), len(held) - 1)] == want]] = False
    return out


def _compared(columns: list[str], compare: Compare, once: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows in order of (key, x, y): pairs of a block of each key with another, or with itself.

    once: rows have all their `keys`, and a pair is named under the first that its members share.
    """

    def pairs(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        """Of whole groups of rows that begin at `starts`."""
        of = {c: table.column(c).to_numpy() for c in ("x", "y", "block", "group", "id", "key")}
        left = np.repeat(np.append(starts[1:], table.num_rows), np.diff(starts, append=table.num_rows)) - 1 - np.arange(table.num_rows)
        a = np.repeat(np.arange(table.num_rows), left)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(left) - left, left)
        apart = (of["group"][a] != of["group"][b]) & ((of["x"][a] == of["y"][a]) | (of["block"][a] != of["block"][b]))
        a, b = a[apart], b[apart]
        if len(a):
            a, b = compare(of["key"], {c: table.column(c).combine_chunks() for c in columns}, a, b)
        if once and len(a):
            first = first_shared(table.column("keys").combine_chunks(), of["key"], a, b)
            a, b = a[first], b[first]
        if not len(a):
            return None
        one, two = of["id"][a], of["id"][b]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest is not None else table
            mark = np.stack([rest.column(c).to_numpy().astype(np.int64) for c in ("key", "x", "y")])
            starts = np.concatenate(([0], np.flatnonzero((np.diff(mark) != 0).any(axis=0)) + 1))
            # the last group may go on in the next batch
            if len(starts) > 1:
                yield from whole(rest.slice(0, starts[-1]).combine_chunks(), starts[:-1])
                rest = rest.slice(starts[-1])
        if rest is not None:
            yield from whole(rest.combine_chunks(), np.zeros(1, np.int64))
        rest = None
        release()

    def whole(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(starts, append=table.num_rows)
        turn = np.cumsum(sizes * (sizes - 1) // 2) // PAIRS
        cuts = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(starts)]
        for c, d in zip(cuts, cuts[1:], strict=False):
            end = starts[d] if d < len(starts) else table.num_rows
            if end - starts[c] > 1 and (found := pairs(table.slice(starts[c], end - starts[c]), starts[c:d] - starts[c])) is not None:
                yield found

    return run


def groups_by_shared_keys(
    items: DataFrame,
    keys: DataFrame,
    may_match: Callable[[str, str], Column],
    confirm: Callable[[DataFrame], tuple[DataFrame, Callable[[DataFrame], DataFrame]]],
    compare: Compare,
) -> DataFrame:
    """The groups that links connect, as `connected_components` has them. Items are linked that share a key, may match and are confirmed.

    `items` has id (long) and the columns that `may_match` compares (given the two sides' prefixes), `keys` has key (long) and id.
    First each key's members are held against its smallest member only: a star has one edge a member. What those edges connect
    counts as one; then, for the keys whose members aren't all connected, members of different groups are held against each
    other as well, inside tasks: each gets two blocks of a key's members, and `compare` names the pairs of them that are worth a
    check. So no pair that could join two groups is lost, and no table ever holds the pairs of a key.
    `confirm(ids)` gets the items that can occur in pairs; it returns the table of what `compare` is given (id and other columns),
    and the function that keeps the true links of pairs.
    """

    summed = keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count("*").alias("n"))
    hubs = settled(summed.where("hub != last"), "hubs")
    # two members are known from the sums; only larger keys' members are looked up
    pairs, larger = hubs.where("n = 2"), hubs.where("n > 2").select("key", "hub")
    few = larger.limit(FEW + 1).count() <= FEW
    crowd = settled(keys.join(F.broadcast(larger) if few else larger, "key").select("key", "id", "hub"), "crowd")
    stars = crowd.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).union(pairs.select("hub", "last")).distinct()
    groups = settled(groups_of_stars(items.withColumn("name", F.col("id")), stars, crowd.select("key", "id"), may_match, confirm, compare), "groups")
    forget(hubs, crowd)
    return groups


def groups_of_stars(
    items: DataFrame,
    stars: DataFrame,
    crowd: DataFrame,
    may_match: Callable[[str, str], Column],
    confirm: Callable[[DataFrame], tuple[DataFrame, Callable[[DataFrame], DataFrame]]],
    compare: Compare,
    once: bool = False,
) -> DataFrame:
    """The groups of `groups_by_shared_keys` from its two parts: star edges (a, b), and the members (key, id) of keys with more than two.

    Star edges give the `name` that items have besides id; items of one name each take part.
    Of a key that star edges don't connect, the members outside its largest group are held against each other and against those inside it;
    so one stray member of a large key costs a look at each of the others, not at each pair of them. Members may come repeatedly. once: a pair that shares many
    keys is named under the first of them only, for which members bring all their keys along; for a `compare` that doesn't see to it itself.
    """
    near_of = lambda side: items.select(*(F.col(c).alias(f"{side}_{c}") for c in items.columns))
    star = stars.select(F.col("a").alias("a_name"), F.col("b").alias("b_name")).join(near_of("a"), "a_name").join(near_of("b"), "b_name")
    star = settled(star.where(may_match("a_", "b_")).select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "star")
    content, check = confirm(star.select(F.col("a").alias("id")).union(star.select("b")).union(crowd.select("id")).distinct())
    near = settled(check(star), "near")
    group = materialize(connected_components(near), "groups")
    member = crowd.join(group, "id", "left").select("key", "id", F.coalesce("component", "id").alias("group"))
    split = member.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least != most").select("key")
    apart = settled(member.join(split, "key").distinct(), "apart")
    counts = apart.groupBy("key", "group").agg(F.count("*").alias("n"))
    tops = counts.groupBy("key").agg(F.max(F.struct("n", "group")).alias("top"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    tops = tops.select("key", F.col("top.group").alias("largest"), blocks(F.col("n") - F.col("top.n")).alias("outside"), blocks(F.col("top.n")).alias("inside"))
    dealt = apart.join(tops, "key")
    # blocks outside the largest group are numbered from 0, those inside it after them
    in_largest = F.col("group") == F.col("largest")
    spread = F.xxhash64("id")
    block = F.when(in_largest, F.col("outside") + F.pmod(spread, F.col("inside"))).otherwise(F.pmod(spread, F.col("outside"))).cast("int")
    others = F.sequence(F.lit(0), F.col("outside") - 1 + F.when(in_largest, 0).otherwise(F.col("inside")))
    dealt = dealt.select("key", "id", "group", block.alias("block"), F.explode(others).alias("other"))
    if once:
        content = content.join(apart.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys")), "id")
    dealt = dealt.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "group").join(content, "id")
    columns = [c for c in content.columns if c not in ("id", "keys")]
    dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "id").select("key", "x", "y", "block", "id", "group", *columns, *(["keys"] if once else []))
    met = settled(dealt.mapInArrow(_compared(columns, compare, once), "a long, b long").distinct(), "met")
    # what was found since connects groups, of which each is named by its smallest member
    of = lambda x: group.select(F.col("id").alias(x), F.col("component").alias(f"{x}_group"))
    more = check(met).join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_group", "a").alias("a"), F.coalesce("b_group", "b").alias("b"))
    wider = materialize(connected_components(more), "wider")
    forget(star, near, apart, met)
    of = wider.select(F.col("id").alias("component"), F.col("component").alias("wider"))
    inside = group.join(of, "component", "left").select("id", F.coalesce("wider", "component").alias("component"))
    return inside.union(wider.join(group, "id", "left_anti").select("id", "component"))
