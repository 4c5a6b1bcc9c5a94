"""Property-graph operators on nodes (id, ..) and edges (source_id, target_id, type, weight, ..)."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import forget, materialized, new_path  # noqa: F401  (others take new_path from here)


def connected_components(links: DataFrame) -> DataFrame:
    """Each node of links (a, b) with the smallest node that it reaches: (id, component).

    Labels spread to neighbours and then jump to their own label's label, so that a path of length n takes about log n rounds.
    """
    live = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct()
    live = materialized(live)
    label = turn = materialized(live.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in count():
        near = live.join(label, live["b"] == label["id"]).groupBy("a").agg(F.min("component").alias("near"))
        best = label.join(near, label["id"] == near["a"]).select("id", F.least("component", "near").alias("best"), F.col("component").alias("old"))
        jump = label.select(F.col("id").alias("best"), F.col("component").alias("jump"))
        new = materialized(best.join(jump, "best", "left").select("id", F.least(F.col("best"), F.coalesce("jump", "best")).alias("component"), "old"))
        forget(turn)
        turn, label = new, new.select("id", "component")
        if new.where("component <> old").isEmpty():
            forget(live)
            return label


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def first_edges(edges: DataFrame, *order: str) -> DataFrame:
    """One edge an ordered pair of nodes: the first, whatever its type."""
    row = F.struct(*order, *(c for c in edges.columns if c not in order))
    return edges.groupBy("source_id", "target_id").agg(F.min(row).alias("__tm")).select(*(F.col("__tm")[c].alias(c) for c in edges.columns))


def orphans(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without an edge, and edges that lack an end."""
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct()
    ids = nodes.select("id").distinct().withColumn("__tm_x", F.lit(True))
    found = edges.join(ids.select(F.col("id").alias("source_id"), F.col("__tm_x").alias("s")), "source_id", "left").join(ids.select(F.col("id").alias("target_id"), F.col("__tm_x").alias("t")), "target_id", "left")
    return nodes.join(ends, "id", "left_anti"), found.where("s is null or t is null").drop("s", "t")


def neighbors(edges: DataFrame, of: DataFrame, direction: str = "both", kind: str | None = None) -> DataFrame:
    """(id, neighbor, type, weight) over outgoing, incoming or both directions of the edges of the ids in `of`."""
    if kind is not None:
        edges = edges.where(F.col("type") == kind)
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("neighbor"), "type", "weight")
    back = edges.select(F.col("target_id").alias("id"), F.col("source_id").alias("neighbor"), "type", "weight")
    every = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return every.join(of.select("id").distinct(), "id", "left_semi")


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in a set of ids."""
    return valid_edges(ids.select("id"), edges)


#: Words of 64 bits in a row of k_hop's tables: as many seeds share a row, a bit each.
WORDS = 8


def k_hop(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, id, hops): what each seed reaches in at most `depth` steps in either direction, by the shortest way; seeds themselves at 0.

    A step goes along all edges once for each part of 64 * `WORDS` seeds, of which a row has a bit each; a pair of seed and node becomes a row
    only in the result.
    """
    both = materialized(edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("to")).union(edges.select("target_id", "source_id")).distinct(), "steps")
    ids = materialized(seeds.select(F.col("id").alias("seed")).distinct(), "seeds")
    count_of = ids.repartition(max(1, -(-ids.count() >> 20))).select("seed", F.monotonically_increasing_id().alias("n"))
    place = materialized(count_of, "places").select("seed", F.expr(f"n div {64 * WORDS}").alias("part"), F.expr(f"cast(n div 64 % {WORDS} as int)").alias("word"), F.expr("cast(n % 64 as int)").alias("bit"))
    marks = [f"m{w}" for w in range(WORDS)]
    own = [F.bit_or(F.when(F.col("word") == w, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).otherwise(F.lit(0).cast("long"))).alias(m) for w, m in enumerate(marks)]
    edge = materialized(place.groupBy(F.col("seed").alias("id"), "part").agg(*own), "reach")
    seen, out = edge, ids.select("seed", F.col("seed").alias("id"), F.lit(0).alias("hops"))
    group = materialized(place.groupBy("part", "word").agg(F.collect_list(F.struct("bit", "seed")).alias("seeds")), "groups")
    none = [F.lit(0).cast("long").alias(f"old_{m}") for m in marks]
    for hop in range(1, depth + 1):
        step = edge.join(both, "id").select(F.col("to").alias("id"), "part", *marks, *none)
        known = seen.select("id", "part", *(F.lit(0).cast("long").alias(m) for m in marks), *(F.col(m).alias(f"old_{m}") for m in marks))
        new = step.unionByName(known).groupBy("id", "part").agg(*(F.bit_or(m).bitwiseAND(F.bitwise_not(F.bit_or(f"old_{m}"))).alias(m) for m in marks))
        edge = materialized(new.where(" or ".join(f"{m} <> 0" for m in marks)), "reach")
        seen = seen.unionByName(edge)
        words = edge.select("id", "part", F.posexplode(F.array(*marks)).alias("word", "mark")).where("mark <> 0").join(group, ["part", "word"])
        here = words.select("id", F.explode(F.filter("seeds", lambda s: F.getbit("mark", s["bit"]) == 1)).alias("s"))
        out = out.unionByName(here.select("s.seed", "id", F.lit(hop).alias("hops")))
    forget(both)
    return out


def shortest_paths(edges: DataFrame, seeds: DataFrame, most_hops: int = 5, cost: Column | None = None) -> DataFrame:
    """(seed, id, cost, hops): the cheapest way of at most `most_hops` edges from each seed along their direction.

    The cost is the weight unless another is given (1 - weight, where a larger weight means nearer).
    """
    step = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("to"), (F.col("weight") if cost is None else cost).alias("c")).groupBy("id", "to").agg(F.min("c").alias("c"))
    best = materialized(seeds.select(F.col("id").alias("seed"), "id", F.lit(0.0).alias("cost"), F.lit(0).alias("hops")))
    for _ in range(most_hops):
        moved = best.join(step, "id").select("seed", F.col("to").alias("id"), (F.col("cost") + F.col("c")).alias("cost"), (F.col("hops") + 1).alias("hops"))
        least = best.unionByName(moved).groupBy("seed", "id").agg(F.min(F.struct("cost", "hops")).alias("m"))
        new = materialized(least.select("seed", "id", "m.cost", "m.hops"))
        forget(best)
        best = new
    return best


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, avg_degree, density, components.

    Components are those of all ids: of nodes, and of ends of edges, which need not be nodes. A node that no edge reaches is one.
    """
    counts = nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))
    found = connected_components(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))
    alone = nodes.select("id").distinct().join(found, "id", "left_anti").agg(F.count("*").alias("alone"))
    linked = found.agg(F.count_distinct("component").alias("c")).crossJoin(alone)
    n, e = F.col("n_nodes"), F.col("n_edges")
    return counts.crossJoin(linked).select(
        n, e, F.when(n > 0, 2 * e / n).otherwise(0.0).alias("avg_degree"), F.when(n > 1, e / (n * (n - 1))).otherwise(0.0).alias("density"), (F.col("c") + F.col("alone")).alias("components")
    )


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(id, degree, centrality: by the largest)."""
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id"))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"))
    return degree.crossJoin(F.broadcast(degree.agg(F.max("degree").alias("m")))).select("id", "degree", (F.col("degree") / F.col("m")).alias("centrality"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, turns: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """(id, rank) by weighted edges. What nodes without edges hold is lost, so that ranks need not add up to 1."""
    out = edges.groupBy("source_id").agg(F.sum("weight").alias("total"))
    share = materialized(edges.join(out, "source_id").where("total > 0").groupBy("source_id", "target_id", "total").agg(F.sum("weight").alias("w")).select("source_id", "target_id", (F.col("w") / F.col("total")).alias("share")))
    ids = nodes.select("id").distinct()
    n = ids.count()
    rank = turn = materialized(ids.select("id", F.lit(1.0 / max(n, 1)).alias("rank")))
    for _ in range(turns):
        got = rank.join(share, rank["id"] == share["source_id"]).groupBy("target_id").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = rank.join(got, rank["id"] == got["target_id"], "left").select("id", (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("old"))
        new = materialized(new)
        forget(turn)
        turn, rank = new, new.select("id", "rank")
        if (new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) < tolerance:
            break
    return rank


def temporal_edges(events: DataFrame, by: list[str], id_col: str, ts: str, minutes: int = 60) -> DataFrame:
    """(source_id, target_id, weight): each event and the next of its group, if that is no more than so many minutes later; 1 - gap / minutes."""
    w = Window.partitionBy(*by).orderBy(ts, id_col)
    rows = events.select(F.col(id_col).alias("source_id"), F.lead(id_col).over(w).alias("target_id"), F.col(ts).alias("t"), F.lead(ts).over(w).alias("u"))
    gap = F.expr("timestampdiff(SECOND, t, u)") / 60
    return rows.where(F.col("target_id").isNotNull() & (gap <= minutes)).select("source_id", "target_id", (1 - gap / minutes).alias("weight"))


def adjacent_links(records: DataFrame, by: list[str], id_col: str, ts: str, entities: str, tags: str, author: str) -> DataFrame:
    """(source_id, target_id, type, weight): each record and the next of its group.

    By time: 0.7 within 4 hours, 0.5 within a day, 0.3 within a week. More weight, and another type, for shared entities (0.5 and
    a tenth each, up to 0.8), shared tags (0.4 and a tenth each, up to 0.6) or, below 0.5, the same author (0.4).
    """
    w = Window.partitionBy(*by).orderBy(ts, id_col)
    nxt = {c: F.lead(c).over(w) for c in (id_col, ts, entities, tags, author)}
    rows = records.select(F.col(id_col).alias("source_id"), nxt[id_col].alias("target_id"), F.col(ts).alias("t"), nxt[ts].alias("u"), *(x.alias(n) for c, n in ((entities, "e"), (tags, "g"), (author, "h")) for x, n in ((F.col(c), f"{n}1"), (nxt[c], f"{n}2"))))
    rows = rows.where("target_id is not null").withColumn("s", F.expr("timestampdiff(SECOND, t, u)"))
    near = F.when(F.col("s") <= 4 * 3600, 0.7).when(F.col("s") <= 24 * 3600, 0.5).when(F.col("s") <= 7 * 24 * 3600, 0.3)
    kind = F.when(F.col("s") <= 24 * 3600, "TEMPORAL").when(F.col("s") <= 7 * 24 * 3600, "RELATES_TO")
    shared = lambda c, base, cap: F.when(F.arrays_overlap(f"{c}1", f"{c}2"), F.least(F.lit(cap), base + F.size(F.array_intersect(f"{c}1", f"{c}2")) * 0.1))
    for value, name, extra in ((shared("e", 0.5, 0.8), "MENTIONS", F.lit(True)), (shared("g", 0.4, 0.6), "HAS_TOPIC", F.lit(True)), (F.when(F.col("h1") == F.col("h2"), 0.4), "AUTHORED_BY", F.coalesce(near < 0.5, F.lit(True)))):
        better = value.isNotNull() & (near.isNull() | ((value > near) & extra))
        kind, near = F.when(better, name).otherwise(kind), F.when(better, value).otherwise(near)
    return rows.select("source_id", "target_id", kind.alias("type"), F.round(near, 6).alias("weight")).where("weight is not null")
