"""Ranking with a graph: personalised PageRank, beams, boosts, explanations, and links to stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import materialized, pagerank


def personalised_pagerank(edges: DataFrame, candidates: DataFrame, alpha: float = 0.85, turns: int = 20, least: float = 1e-4) -> DataFrame:
    """(id, ppr): mass 1/n on each of n candidates; of what a node gets it keeps alpha and passes the rest on by weight. By the largest.

    Residuals below `least` stop. What nodes without edges would pass on is lost. Only candidates are returned, as mass may leave them.
    """
    share = edges.join(edges.groupBy("source_id").agg(F.sum("weight").alias("t")), "source_id").where("t > 0").select("source_id", "target_id", (F.col("weight") / F.col("t")).alias("share"))
    share = materialized(share)
    ids = candidates.select("id").distinct()
    n = max(ids.count(), 1)
    rest = materialized(ids.withColumn("r", F.lit(1.0 / n)))
    kept = rest.select("id", (F.col("r") * alpha).alias("p"))
    for _ in range(turns):
        live = rest.where(F.col("r") >= least)
        rest = materialized(live.join(share, live["id"] == share["source_id"]).groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("r") * (1 - alpha) * F.col("share")).alias("r")))
        if rest.where(F.col("r") >= least).isEmpty():
            break
        kept = kept.unionByName(rest.where(F.col("r") >= least).select("id", (F.col("r") * alpha).alias("p")))
    total = kept.groupBy("id").agg(F.sum("p").alias("p")).join(ids, "id", "left_semi")
    return total.crossJoin(F.broadcast(total.agg(F.max("p").alias("m")))).select("id", (F.col("p") / F.col("m")).alias("ppr"))


def candidate_features(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, score, ppr, recency, centrality) of candidates (id, score, ts); each of the latter three is between 0 and 1."""
    ids = candidates.select("id")
    own = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    degree = own.groupBy(F.col("source_id").alias("id")).agg(F.sum("weight").alias("deg"))
    bounds = F.broadcast(candidates.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")))
    top = F.broadcast(degree.agg(F.max("deg").alias("top")))
    age, span = F.timestamp_diff("SECOND", F.col("lo"), F.col("ts")), F.timestamp_diff("SECOND", F.col("lo"), F.col("hi"))
    out = candidates.join(personalised_pagerank(own, candidates), "id", "left").join(degree, "id", "left").crossJoin(bounds).crossJoin(top)
    return out.select("id", "score", F.coalesce("ppr", F.lit(0.0)).alias("ppr"), F.when(span > 0, age / span).otherwise(0.0).alias("recency"), F.coalesce(F.col("deg") / F.col("top"), F.lit(0.0)).alias("centrality"))


def retrieval(edges: DataFrame, candidates: DataFrame, n: int = 20) -> DataFrame:
    """(id, final): the best by 0.55 score, 0.20 ppr, 0.15 recency and 0.10 centrality. No candidates give no rows."""
    f = candidate_features(edges, candidates)
    final = 0.55 * F.col("score") + 0.20 * F.col("ppr") + 0.15 * F.col("recency") + 0.10 * F.col("centrality")
    return f.select("id", final.alias("final")).orderBy(F.desc("final"), "id").limit(n)


def composed(edges: DataFrame, candidates: DataFrame, n: int = 20, most: int = 50, width: int = 5, depth: int = 2, keep: float = 0.7) -> DataFrame:
    """(id, place, fast, final): the whole pipeline over candidates (id, score, ts, embedding, and `cross`, a second score, if there is one).

    The best `most` by score are candidates. Each gets `fast` (see `retrieval`) from the graph that they span; beams over that graph take
    those on the best ways; `final` adds the second score; the n results are chosen in turn for 0.7 final less 0.3 the largest cosine to
    those before. All but the scan of candidates and edges is bounded by `most`. Ties: the smaller id.
    """
    from .search import mmr

    few = materialized(candidates.orderBy(F.desc("score"), "id").limit(most))
    ids = few.select("id")
    own = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    own = materialized(own)
    f = candidate_features(own, few)
    fast = materialized(f.select("id", (0.55 * F.col("score") + 0.20 * F.col("ppr") + 0.15 * F.col("recency") + 0.10 * F.col("centrality")).alias("fast")))
    way = beam(own, fast.select("id", F.round("fast", 9).alias("score")), width, depth)
    cross = F.coalesce("cross", F.lit(0.0)) if "cross" in few.columns else F.lit(0.0)
    ranked = few.join(fast, "id").join(way.select("id"), "id", "left_semi").select("id", "embedding", "fast", (F.col("fast") + cross).alias("final"))
    chosen = mmr(ranked.select("id", F.round("final", 9).alias("score"), "embedding"), n, most, keep)
    return chosen.join(ranked.select("id", "fast", "final"), "id").select("id", "place", "fast", "final")


def beam(edges: DataFrame, scores: DataFrame, width: int = 5, depth: int = 2) -> DataFrame:
    """(id, place): candidates (id, score) on the best paths: from the best `width`, each turn the best `width` new neighbours among candidates.

    A node is visited once: by the path whose last node has the better score.
    """
    best = lambda df: df.orderBy(F.desc("score"), "id").limit(width)
    beams = materialized(best(scores.select("id", "score")).withColumn("path", F.array("id")))
    seen = beams.select("id")
    step = edges.select(F.col("source_id").alias("last"), F.col("target_id").alias("to")).distinct()
    for _ in range(depth):
        new = beams.select(F.col("id").alias("last"), F.col("score").alias("from_score"), "path").join(step, "last").join(scores.select(F.col("id").alias("to"), "score"), "to")
        new = new.join(seen.withColumnRenamed("id", "to"), "to", "left_anti")
        one = new.groupBy("to").agg(F.max_by(F.struct("path", "score"), F.struct("from_score", -F.col("last"))).alias("b"))
        found = materialized(one.select(F.col("to").alias("id"), "b.score", F.array_append("b.path", F.col("to")).alias("path")))
        if found.isEmpty():
            break
        seen = seen.union(found.select("id"))
        beams = materialized(best(found))
    rows = beams.select("score", F.col("id").alias("end"), F.posexplode("path").alias("k", "id"))
    first = rows.groupBy("id").agg(F.min(F.struct(-F.col("score"), "end", "k")).alias("o"))
    return first.select("id", F.row_number().over(Window.orderBy("o")).alias("place"))


def boost(results: DataFrame, hops: DataFrame) -> DataFrame:
    """Results (id, score) times 1.3, 1.2 or 1.1 for a way of 1, 2 or 3 hops from the query's entities, plus a tenth of its strength 1/hops."""
    near = hops.where("hops > 0").groupBy("id").agg(F.min("hops").alias("hops"))
    factor = F.when(F.col("hops") == 1, 1.3).when(F.col("hops") == 2, 1.2).when(F.col("hops") == 3, 1.1).otherwise(1.0)
    strength = F.when(F.col("hops") <= 3, 0.1 / F.col("hops")).otherwise(0.0)
    return results.join(near, "id", "left").select("id", (F.col("score") * F.coalesce(factor, F.lit(1.0)) + F.coalesce(strength, F.lit(0.0))).alias("score"))


def explain(items: DataFrame, edges: DataFrame, order: tuple[str, ...] = ("TEMPORAL", "MENTIONS", "SIMILAR")) -> DataFrame:
    """(id, time, entity, similar): each item's heaviest neighbour by each kind of edge, along a chain: the entity of the time's end, and so on.

    A link that is missing leaves the rest null.
    """
    out, at = items.select("id").withColumn("at", F.col("id")), []
    for k, kind in enumerate(order):
        best = edges.where(F.col("type") == kind).groupBy(F.col("source_id").alias("at")).agg(F.max_by("target_id", F.struct("weight", -F.col("target_id"))).alias(f"s{k}"))
        out = out.join(best, "at", "left").withColumn("at", F.col(f"s{k}"))
        at.append(F.col(f"s{k}").alias(("time", "entity", "similar")[k]))
    return out.select("id", *at)


def related(edges: DataFrame, ids: DataFrame, n: int = 5, least: float = 0.0) -> DataFrame:
    """(id, neighbor, weight, place): the n heaviest neighbours of each id, in either direction."""
    both = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("neighbor"), "weight").union(edges.select("target_id", "source_id", "weight"))
    own = both.join(ids.select("id").distinct(), "id", "left_semi").where(F.col("weight") > least).groupBy("id", "neighbor").agg(F.max("weight").alias("weight"))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "neighbor"))).where(F.col("place") <= n)


def expanded(queries: DataFrame, links: DataFrame, labels: DataFrame, n: int = 5, least: float = 0.3) -> DataFrame:
    """(query_id, text): a query's text and the labels of up to n related entities with a weight above `least`."""
    near = related(links, queries.select(F.col("entity").alias("id")), n, least).join(labels.select(F.col("id").alias("neighbor"), "label"), "neighbor")
    words = near.groupBy(F.col("id").alias("entity")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias("more"))
    return queries.join(words, "entity", "left").select("query_id", F.concat_ws(" ", F.col("text"), F.coalesce("more", F.array().cast("array<string>"))).alias("text"))


def from_sessions(session_messages: DataFrame, first: int = 10) -> DataFrame:
    """Edges (source_id, target_id, type, weight) of sessions' first messages (session, chunk, place, entities): a chunk is part of its
    session (1.0), and a session mentions its entities (0.8).
    """
    few = session_messages.where(F.col("place") <= first)
    part = few.select(F.col("chunk").alias("source_id"), F.col("session").alias("target_id"), F.lit("PART_OF").alias("type"), F.lit(1.0).alias("weight"))
    names = few.select(F.col("session").alias("source_id"), F.explode("entities").alias("target_id"), F.lit("MENTIONS").alias("type"), F.lit(0.8).alias("weight"))
    return part.unionByName(names).distinct()


def score_similarity(score: Column) -> Column:
    """1 / (1 + the distance that a score stands for, the root of 1 - score)."""
    return 1 / (1 + F.sqrt(F.greatest(F.lit(0.0), 1 - score)))


def link_existing(new: DataFrame, old: DataFrame, by: list[str], id_col: str, ts: str, author: str, latest: int = 50, most: int = 20, hours: int = 24) -> DataFrame:
    """(source_id, target_id, weight, reason): from each new record to stored ones of its group, the newest `latest` of them, at most `most`.

    0.6 within so many hours, else 0.4 for the same author; others get no link.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(ts), id_col)
    known = old.withColumn("__tm_p", F.row_number().over(w)).where(F.col("__tm_p") <= latest)
    b = known.select(*by, F.col(id_col).alias("target_id"), F.col(ts).alias("__tm_t"), F.col(author).alias("__tm_a"))
    pairs = new.join(b, by)
    near = F.abs(F.timestamp_diff("SECOND", F.col("__tm_t"), F.col(ts))) <= hours * 3600
    weight = F.when(near, 0.6).when(F.col(author) == F.col("__tm_a"), 0.4)
    rows = pairs.select(F.col(id_col).alias("source_id"), "target_id", weight.alias("weight"), F.when(near, "time").otherwise("author").alias("reason"), "__tm_t").where("weight is not null")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("weight"), F.desc("__tm_t"), "target_id"))
    return rows.withColumn("__tm_p", place).where(F.col("__tm_p") <= most).drop("__tm_p", "__tm_t")


def cluster_rank(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, rank): the mean PageRank of a cluster's members (id, cluster)."""
    return pagerank(nodes, edges).join(members, "id").groupBy("cluster").agg(F.avg("rank").alias("rank"))
