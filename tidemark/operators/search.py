"""Text search, vector search and the fusion of ranked lists. Every list has a total order: score, then id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .ranks import ranked as placed


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None, only: list[str] | None = None) -> DataFrame:
    """(id, term, tf, len): an inverted index. Documents without a token have no row.

    With `only` it has these terms alone, for a search without a stored index: other tokens are counted but never shuffled.
    """
    own = X.tokens(F.col(text_col)) if tokens is None else tokens
    rows = docs.select(F.col(id_col).alias("id"), own.alias("t")).select("id", F.size("t").alias("len"), F.explode("t").alias("term"))
    rows = rows if only is None else rows.where(F.col("term").isin(*only))
    return rows.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def corpus_size(docs: DataFrame, text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """One row (n, total): documents that have a token, and tokens."""
    size = F.size(X.tokens(F.col(text_col)) if tokens is None else tokens)
    return docs.select(size.alias("s")).where("s > 0").agg(F.count("*").alias("n"), F.sum("s").alias("total"))


def bm25(index: DataFrame, query: list[str], n_docs: int | None = None, corpus: DataFrame | None = None, k1: float = 1.5, b: float = 0.75, idf: str = "plus") -> DataFrame:
    """(id, score) of documents that have a query term; a term that the query repeats counts as often.

    idf `plus` is ln((N - df + .5) / (df + .5) + 1); `okapi` lacks the 1, and negative ones become a quarter of the mean of all
    terms' idf. `n_docs` counts documents without tokens too; by default those of the index. Only the postings of the query's terms
    are joined; the size of the corpus and its mean length are one row, `corpus`, which is counted from a full index if it isn't given.
    """
    if corpus is None:
        corpus = index.groupBy("id").agg(F.first("len").alias("len")).agg(F.count("*").alias("n"), F.sum("len").alias("total"))
    corpus = corpus.select((F.lit(n_docs) if n_docs else F.col("n")).alias("n"), "total")
    times = {t: query.count(t) for t in query}
    hit = index.where(F.col("term").isin(list(times)))
    ratio = (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)
    if idf == "okapi":
        every = index.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus))
        mean = every.agg(F.avg(F.log(ratio)).alias("mean"))
        df = every.where(F.col("term").isin(list(times))).crossJoin(F.broadcast(mean)).withColumn("idf", F.when(ratio < 1, F.col("mean") * 0.25).otherwise(F.log(ratio)))
    else:
        df = hit.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus)).withColumn("idf", F.log(ratio + 1))
    weight = F.create_map(*(F.lit(x) for t, n in times.items() for x in (t, float(n))))[F.col("term")]
    scored = hit.join(F.broadcast(df.select("term", "idf", "n", "total")), "term")
    length = F.col("len") / (F.col("total") / F.col("n"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length)) * weight
    return scored.groupBy("id").agg(F.sum(part).alias("score"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """The k best of (id, score): per-task heaps, no sort of all."""
    return scores.orderBy(F.desc("score"), "id").limit(k)


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best with rank from 1."""
    best = top_k(scores, k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)).cast("double") * F.coalesce(y, F.lit(0.0)).cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; the shorter vector counts as padded with zeros, and a zero vector is like nothing (0)."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def distance(a: Column, b: Column) -> Column:
    """Euclidean."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def l2_similarity(d: Column) -> Column:
    return 1 / (1 + d)


def cosines(vectors: DataFrame, query: list[float], id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, score): the cosine of every vector to one query vector. The query is a literal: no join."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(F.col(id_col).alias("id"), cosine(F.col(vec_col), q).alias("score"))


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vec_col: str = "embedding", but: object = None) -> DataFrame:
    """(id, score): the k nearest by cosine to one query vector, exactly."""
    rows = vectors.where(F.col(id_col) != F.lit(but)) if but is not None else vectors
    return top_k(cosines(rows, query, id_col, vec_col), k)


def rrf(lists: list[DataFrame], weights: list[float] | None = None, k: int = 60, depth: int = 200) -> DataFrame:
    """Reciprocal rank fusion of (id, score) lists: (id, score, rank_1, rank_2, ..), the weighted sum of 1 / (k + rank), ranks from 1."""
    weights = weights or [1.0] * len(lists)
    parts = [ranked(x, depth).select("id", F.lit(n).alias("list"), "rank", (w / (F.lit(k) + F.col("rank"))).alias("part")) for n, (x, w) in enumerate(zip(lists, weights, strict=True))]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("id").agg(F.sum("part").alias("score"), *(F.max(F.when(F.col("list") == n, F.col("rank"))).alias(f"rank_{n + 1}") for n in range(len(lists))))


def combine(a: DataFrame, b: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """(id, score): the sum of two lists' scores, 0 where one lacks an id, times the id's weight (1 if it has none)."""
    both = a.select("id", F.col("score").alias("x")).join(b.select("id", F.col("score").alias("y")), "id", "full_outer")
    total = F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0))
    if weights is None:
        return both.select("id", total.alias("score"))
    return both.join(weights, "id", "left").select("id", (total * F.coalesce("weight", F.lit(1.0))).alias("score"))


def best_of(*lists: DataFrame) -> DataFrame:
    """Union of lists; an id keeps its best score."""
    return reduce(DataFrame.unionByName, (x.select("id", "score") for x in lists)).groupBy("id").agg(F.max("score").alias("score"))


def rank_similarity(scores: DataFrame) -> DataFrame:
    """Adds similarity: (n - rank + 1) / n over the whole list."""
    places = placed(scores, F.desc("score"), "id", out="__tm_r", total="__tm_all")
    return places.withColumn("similarity", (F.col("__tm_all") - F.col("__tm_r") + 1) / F.col("__tm_all")).drop("__tm_r", "__tm_all")


def min_max(scores: DataFrame, invert: bool = True) -> DataFrame:
    """Adds normalized: 1 minus the place between least and greatest; 1 if all are equal. The two bounds are one row."""
    bounds = F.broadcast(scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi")))
    place = (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return scores.crossJoin(bounds).withColumn("normalized", F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(1 - place if invert else place)).drop("lo", "hi")


def quota(scores: DataFrame, by: str, per: int, total: int) -> DataFrame:
    """The best `total` rows of which each group has at most `per`."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))
    return scores.withColumn("__tm_p", place).where(F.col("__tm_p") <= per).drop("__tm_p").orderBy(F.desc("score"), "id").limit(total)


def mmr(candidates: DataFrame, n: int, most: int = 50, keep: float = 0.7) -> DataFrame:
    """(id, place): greedy selection of `n` from the best `most` (id, score, embedding): 0.7 score minus 0.3 the largest cosine to those chosen.

    Bounded by `most`: the candidates are one group of a single task.
    """
    import numpy as np
    import pandas as pd

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "id"], ascending=[False, True], ignore_index=True)
        v = np.array(g["embedding"].tolist(), float)
        size = np.linalg.norm(v, axis=1, keepdims=True)
        v = np.divide(v, size, out=np.zeros_like(v), where=size > 0)
        near, left, out = np.zeros(len(g)), list(range(len(g))), []
        while left and len(out) < n:
            value = keep * g["score"].to_numpy()[left] - (1 - keep) * near[left]
            k = left.pop(int(value.argmax()))
            out.append(k)
            near = np.maximum(near, v @ v[k]) if len(out) > 1 else v @ v[k]
        return pd.DataFrame({"id": g["id"].to_numpy()[out], "place": range(1, len(out) + 1)})

    few = candidates.select("id", "score", "embedding", F.lit(0).alias("one")).orderBy(F.desc("score"), "id").limit(most)
    return few.groupBy("one").applyInPandas(run, f"id {candidates.schema['id'].dataType.simpleString()}, place int")


def text_filter(df: DataFrame, *, source: str | None = None, tags: list[str] | None = None, start: object = None, end: object = None, tags_mode: str = "all") -> DataFrame:
    """By source, by tags (`all` of them or `any`) and by time; rows without a time pass the time filter."""
    if source is not None:
        df = df.where(F.col("source") == source)
    if tags:
        wanted = F.array(*map(F.lit, tags))
        df = df.where(F.size(F.array_except(wanted, F.col("tags"))) == 0 if tags_mode == "all" else F.arrays_overlap(F.col("tags"), wanted))
    if start is not None:
        df = df.where(F.col("ts").isNull() | (F.col("ts") >= F.lit(start)))
    return df.where(F.col("ts").isNull() | (F.col("ts") <= F.lit(end))) if end is not None else df


def where(filters: dict) -> Column:
    """A condition from nested dicts: {"$and": [..]}, {"$or": [..]}, {"column": value} and {"column": {"$eq" | "$ne": value}}.

    `$ne` holds for null as well.
    """
    made = []
    for key, value in filters.items():
        if key in ("$and", "$or"):
            parts = [where(x) for x in value]
            made.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), parts))
        elif isinstance(value, dict):
            ((op, operand),) = value.items()
            made.append({"$eq": F.col(key).eqNullSafe(F.lit(operand)), "$ne": ~F.col(key).eqNullSafe(F.lit(operand))}[op])
        else:
            made.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, made, F.lit(True))


def match(tokens: Column, terms: list[str]) -> Column:
    """Whether a document's tokens match a query: all of up to three terms; of more, the first two and any of the rest."""
    has = lambda t: F.array_contains(tokens, t)
    if not terms:
        return F.lit(False)
    if len(terms) <= 3:
        return reduce(lambda a, b: a & b, map(has, terms))
    return has(terms[0]) & has(terms[1]) & reduce(lambda a, b: a | b, map(has, terms[2:]))


#: Weight of the database, weight of the artifacts and number of results by intent.
INTENTS = {"informational": (0.5, 0.5, 15), "transactional": (0.7, 0.3, 10), "navigational": (0.8, 0.2, 5), "analytical": (0.4, 0.6, 20)}


def confidence(results: DataFrame, *by: str) -> DataFrame:
    """0.7 times the mean score plus 0.3 times the number of results by 10, both at most 1: one row, or one for each key."""
    return results.groupBy(*by).agg(F.least(F.lit(1.0), F.coalesce(F.avg("score"), F.lit(0.0)) * 0.7 + F.least(F.count("*") / 10, F.lit(1.0)) * 0.3).alias("confidence"))


def max_normalised(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Adds score: each column by its largest value, weighed. A column whose largest value isn't above 0 adds nothing. The maxima are one row."""
    top = F.broadcast(df.agg(*(F.max(c).alias(f"__tm_{c}") for c in weights)))
    part = lambda c, w: F.when(F.col(f"__tm_{c}") > 0, F.coalesce(F.col(c), F.lit(0.0)) / F.col(f"__tm_{c}") * w).otherwise(0.0)
    return df.crossJoin(top).withColumn("score", sum((part(c, w) for c, w in weights.items()), F.lit(0.0))).drop(*(f"__tm_{c}" for c in weights))


def after_cut(scores: DataFrame, records: DataFrame, condition: Column, depth: int = 200) -> DataFrame:
    """The best `depth` of (id, score) that then meet a condition on their record: fewer may be left."""
    return top_k(scores, depth).join(records.where(condition).select("id"), "id", "left_semi")


def routed(kind: str, *, words: DataFrame | None = None, vectors: DataFrame | None = None, k: int = 10) -> DataFrame:
    """A search of a kind over ranked lists (id, score): hybrid fuses both, embedding and similar take the vectors', text the words'."""
    if kind == "hybrid" and words is not None and vectors is not None:
        return top_k(rrf([vectors, words], [0.6, 0.4]).select("id", "score"), k)
    if kind in ("embedding", "similar", "hybrid") and vectors is not None:
        return top_k(vectors, k)
    if kind in ("text", "hybrid") and words is not None:
        return top_k(words, k)
    raise ValueError(f"no list for a search of kind {kind!r}")


def intent_weighted(database: DataFrame, artifacts: DataFrame, intent: str) -> DataFrame:
    """(id, score): both lists' scores weighed by the intent's table, summed by id, as many as it says; 0.6, 0.4 and 10 for any other intent."""
    a, b, k = INTENTS.get(intent, (0.6, 0.4, 10))
    both = database.select("id", (F.col("score") * a).alias("score")).unionByName(artifacts.select("id", (F.col("score") * b).alias("score")))
    return top_k(both.groupBy("id").agg(F.sum("score").alias("score")), k)
