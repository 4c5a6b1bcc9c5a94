"""Queries of text search, vector search, fusion and clusters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import search as S
from ..operators import vectors as V
from ..operators.neighbors import NeighborIndex
from ..shared import new_path
from ..sources.tables import load
from .registry import query

TERMS = ["the", "tion", "erst", "the"]


def _index(spark: SparkSession, d: str) -> DataFrame:
    return S.postings(load(spark, d, "documents"), tokens=_tokens())


def _tokens():  # noqa: ANN202  (a Column)
    return F.array_remove(F.split(F.col("text"), " "), "")


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    """A search without a stored index."""
    docs = load(spark, d, "documents")
    return S.bm25(S.postings(docs, tokens=_tokens(), only=TERMS), TERMS, corpus=S.corpus_size(docs, tokens=_tokens()))


def _bm25_sql(idf: str = "ln((n - df + 0.5) / (df + 0.5) + 1)") -> str:
    return f"""t AS (SELECT doc_id AS id, unnest(list_filter(string_split(text, ' '), lambda x: x <> '')) AS term FROM documents), l AS (SELECT id, count(*)::DOUBLE AS len FROM t GROUP BY 1),
  a AS (SELECT count(*)::DOUBLE AS n, avg(len) AS avgdl FROM l), p AS (SELECT id, term, count(*)::DOUBLE AS tf FROM t GROUP BY 1, 2), f AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY 1),
  i AS (SELECT term, {idf} AS idf FROM f, a), q AS (SELECT * FROM (VALUES ('the', 2.0::DOUBLE), ('tion', 1.0), ('erst', 1.0)) v(term, times)),
  b AS (SELECT id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avgdl)) * times) AS score FROM p JOIN q USING (term) JOIN i USING (term) JOIN l USING (id), a GROUP BY 1)"""


@query(f"WITH {_bm25_sql()} SELECT id, round(score, 8) AS score FROM b")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    return _bm25(spark, d).withColumn("score", F.round("score", 8))


@query(f"""WITH {_bm25_sql("CASE WHEN ln((n - df + 0.5) / (df + 0.5)) < 0 THEN 0.25 * (SELECT avg(ln((n - df + 0.5) / (df + 0.5))) FROM f, a) ELSE ln((n - df + 0.5) / (df + 0.5)) END")} SELECT id, round(score, 8) AS score FROM b""")
def bm25_okapi(spark: SparkSession, d: str) -> DataFrame:
    return S.bm25(_index(spark, d), TERMS, idf="okapi").withColumn("score", F.round("score", 8))


@query(f"""WITH {_bm25_sql()}, k AS (SELECT id, score FROM b ORDER BY score DESC, id LIMIT 50)
  SELECT id, round(CASE WHEN max(score) OVER () = min(score) OVER () THEN 1 ELSE 0.5 + 0.5 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END, 8) AS score FROM k""")
def fts_normalized(spark: SparkSession, d: str) -> DataFrame:
    best = S.top_k(_bm25(spark, d), 50)
    out = S.min_max(best, invert=False)
    return out.select("id", F.round(0.5 + 0.5 * F.col("normalized"), 8).alias("score"))


_COS = "SELECT vec_id AS id, list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q.v) / (sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) * sqrt(list_dot_product(q.v, q.v))) AS score FROM embeddings, (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE vec_id = 7) q"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in load(spark, d, "embeddings").where("vec_id = 7").first().embedding]


@query(f"SELECT id, round(score, 6) AS score FROM ({_COS}) WHERE id <> 7 ORDER BY score DESC, id LIMIT 10")
def knn_search(spark: SparkSession, d: str) -> DataFrame:
    return S.knn(load(spark, d, "embeddings"), _query_vector(spark, d), 10, but=7).withColumn("score", F.round("score", 6))


@query("""SELECT vec_id AS id, round(1 / (1 + sqrt(list_sum(list_transform(list_zip(embedding, q.v), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2))))), 6) AS similarity FROM embeddings, (SELECT embedding AS v FROM embeddings WHERE vec_id = 7) q""")
def l2_similarity(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*map(F.lit, _query_vector(spark, d)))
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(S.l2_similarity(S.distance(F.col("embedding"), q)), 6).alias("similarity"))


_RRF = f"""{_bm25_sql()}, c AS ({_COS}), v1 AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM c), b1 AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS r FROM b),
  u AS (SELECT id, 1 AS l, r FROM v1 WHERE r <= 200 UNION ALL SELECT id, 2, r FROM b1 WHERE r <= 200)"""


def _lists(spark: SparkSession, d: str) -> list[DataFrame]:
    """Both lists with scores to nine digits, so that equal ones are ties however they were added up."""
    both = [S.cosines(load(spark, d, "embeddings"), _query_vector(spark, d)), _bm25(spark, d)]
    return [x.withColumn("score", F.round("score", 9)) for x in both]


@query(f"WITH {_RRF} SELECT id, round(sum(CASE l WHEN 1 THEN 0.6 ELSE 0.4 END::DOUBLE / (60 + r)), 10) AS score, max(r) FILTER (l = 1) AS rank_1, max(r) FILTER (l = 2) AS rank_2 FROM u GROUP BY 1")
def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    out = S.rrf(_lists(spark, d), [0.6, 0.4], 60, 200)
    return out.withColumns({"score": F.round("score", 10), "rank_1": F.col("rank_1").cast("long"), "rank_2": F.col("rank_2").cast("long")})


@query(f"WITH {_RRF} SELECT id, round(sum(1::DOUBLE / (60 + r)), 10) AS score FROM u GROUP BY 1 ORDER BY sum(1::DOUBLE / (60 + r)) DESC, id LIMIT 50")
def rrf_unweighted(spark: SparkSession, d: str) -> DataFrame:
    return S.top_k(S.rrf(_lists(spark, d)).select("id", "score"), 50).withColumn("score", F.round("score", 10))


@query(f"WITH {_bm25_sql()}, c AS ({_COS}) SELECT id, round((coalesce(c.score, 0) + coalesce(b.score, 0)) * CASE WHEN id % 10 = 0 THEN 1.5 ELSE 1 END, 6) AS score FROM c FULL JOIN b USING (id)")
def combined_scores(spark: SparkSession, d: str) -> DataFrame:
    ids = load(spark, d, "documents").select(F.col("doc_id").alias("id")).union(load(spark, d, "embeddings").select("vec_id")).distinct()
    weights = ids.where("id % 10 = 0").withColumn("weight", F.lit(1.5))
    v = S.cosines(load(spark, d, "embeddings"), _query_vector(spark, d))
    return S.combine(v, _bm25(spark, d), weights).withColumn("score", F.round("score", 6))


@query("SELECT id, max(s) AS score FROM (SELECT user_id AS id, value AS s FROM events WHERE event_type = 'view' UNION ALL SELECT user_id, value FROM events WHERE event_type = 'click') GROUP BY 1")
def candidate_union_best(spark: SparkSession, d: str) -> DataFrame:
    part = lambda kind: load(spark, d, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("id"), F.col("value").alias("score"))
    return S.best_of(part("view"), part("click"))


@query(f"WITH c AS ({_COS}) SELECT id, round((count(*) OVER () - row_number() OVER (ORDER BY score DESC, id) + 1)::DOUBLE / count(*) OVER (), 8) AS similarity FROM c")
def rank_similarity(spark: SparkSession, d: str) -> DataFrame:
    return S.rank_similarity(S.cosines(load(spark, d, "embeddings"), _query_vector(spark, d))).select("id", F.round("similarity", 8).alias("similarity"))


@query("""SELECT event_id AS id, user_id % 10 AS chat, value AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 10 ORDER BY value DESC, event_id) AS p FROM events) WHERE p <= 40 ORDER BY value DESC, event_id LIMIT 100""")
def quota_top_k(spark: SparkSession, d: str) -> DataFrame:
    return S.quota(load(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("chat"), F.col("value").alias("score")), "chat", 40, 100)


@query()
def mmr_selection(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    scored = S.knn(e, _query_vector(spark, d), 50).join(e.select(F.col("vec_id").alias("id"), "embedding"), "id")
    return S.mmr(scored, 10)


@query("SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the') AND list_contains(string_split(text, ' '), 'of') AND (list_contains(string_split(text, ' '), 'erst') OR list_contains(string_split(text, ' '), 'tion'))")
def match_expression(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where(S.match(F.split("text", " "), ["the", "of", "erst", "tion"])).select("doc_id")


@query("SELECT doc_id FROM documents WHERE (lang = 'en' OR lang = 'de') AND source <> 'src0' AND n_chars > 0")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    condition = S.where({"$and": [{"$or": [{"lang": "en"}, {"lang": {"$eq": "de"}}]}, {"source": {"$ne": "src0"}}]})
    return load(spark, d, "documents").where(condition & (F.col("n_chars") > 0)).select("doc_id")


@query("SELECT event_id FROM events WHERE list_has_all([event_type, CAST(user_id % 3 AS VARCHAR)], ['click', '1']) AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'")
def tags_superset_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").withColumn("tags", F.array("event_type", (F.col("user_id") % 3).cast("string")))
    return S.text_filter(rows, tags=["click", "1"], start=datetime(2024, 1, 5), end=datetime(2024, 1, 25)).select("event_id")


@query("SELECT event_id FROM events WHERE list_has_any([event_type, CAST(user_id % 3 AS VARCHAR)], ['click', '1'])")
def tags_any_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").withColumn("tags", F.array("event_type", (F.col("user_id") % 3).cast("string")))
    return S.text_filter(rows, tags=["click", "1"], tags_mode="any").select("event_id")


@query("SELECT source, round(least(1, avg(n_chars / 50000) * 0.7 + least(count(*) / 10, 1) * 0.3), 8) AS confidence FROM documents GROUP BY 1")
def result_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("source", (F.col("n_chars") / 50000).alias("score"))
    return S.confidence(rows, "source").select("source", F.round("confidence", 8).alias("confidence"))


_UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE / sqrt(list_dot_product(list_transform(embedding, lambda w: w::DOUBLE), list_transform(embedding, lambda w: w::DOUBLE)))) AS v FROM embeddings)"


@query(f"WITH {_UNIT} SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.4")
def similarity_join(spark: SparkSession, d: str) -> DataFrame:
    return V.blocked_pairs(load(spark, d, "embeddings"), least=0.4).withColumn("score", F.round("score", 6))


@query(f"WITH {_UNIT}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 12) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id) SELECT a, b, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM p) WHERE rank <= 5")
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return V.blocked_pairs(load(spark, d, "embeddings"), k=5).withColumn("score", F.round("score", 6))


@query(f"WITH {_UNIT}, p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v), 12) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT a, b, round(s, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rank FROM p) WHERE rank <= 10")
def knn_search_each(spark: SparkSession, d: str) -> DataFrame:
    """All rows whose id is divisible by 20 as queries, against all rows."""
    e = load(spark, d, "embeddings")
    return V.nearest(e.where("vec_id % 20 = 0"), e, 10).withColumn("score", F.round("score", 6))


@query()
def approximate_search(spark: SparkSession, d: str) -> DataFrame:
    """All rows whose id is divisible by 20 as queries, through an index of sqrt(n) cells.

    The given vectors have no clusters: three quarters of the cells are ranked by codes, and 100 rows a query are scored.
    """
    e = load(spark, d, "embeddings")
    index = NeighborIndex.build(e, new_path(spark, "index"))
    probes = -(-3 * len(index.cells.fine) // 4)
    return index.search(e.where("vec_id % 20 = 0"), 10, probes, 100).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {_UNIT}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) >= 0.4),
  r AS (SELECT vec_id AS id, vec_id AS reach FROM u UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.reach) SELECT id AS vec_id, min(reach) AS component FROM r GROUP BY 1""")
def threshold_components(spark: SparkSession, d: str) -> DataFrame:
    return V.linked(load(spark, d, "embeddings"), 0.4)


@query()
def star_clusters(spark: SparkSession, d: str) -> DataFrame:
    return V.star_clusters(load(spark, d, "embeddings"), 0.4)


@query("""SELECT label, max(n) AS n, list(x ORDER BY pos) AS centroid FROM (SELECT label, pos, count(*) AS n, round(avg(x::DOUBLE), 5) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, 64)) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1""")
def cluster_centroids(spark: SparkSession, d: str) -> DataFrame:
    digits = lambda x: F.signum(x) * F.round(F.abs(x), 5)  # noqa: E731  (SQL rounds a small negative number to -0.0)
    return V.centroids(load(spark, d, "embeddings"), "label").withColumn("centroid", F.transform("centroid", digits))


@query(f"WITH {_UNIT}, c AS (SELECT a.label, a.vec_id, round(sum(1 - list_dot_product(a.v, b.v)), 9) AS cost FROM u a JOIN u b ON a.label = b.label GROUP BY 1, 2) SELECT label, arg_min(vec_id, (cost, vec_id)) AS medoid FROM c GROUP BY 1")
def cluster_medoids(spark: SparkSession, d: str) -> DataFrame:
    return V.medoids(load(spark, d, "embeddings"), "label")


@query("""WITH s AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS p, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings), r AS (SELECT *, CASE WHEN p = 10 THEN 0 ELSE sqrt(list_sum(list_transform(list_zip(embedding, b), lambda q: pow(q[1]::DOUBLE - q[2]::DOUBLE, 2)))) END AS dd FROM s WHERE p <= 10)
  SELECT label, round(sum(dd), 5) AS cusum, sum(dd) > 0.5 AS drifted FROM r GROUP BY 1""")
def drift_cusum(spark: SparkSession, d: str) -> DataFrame:
    return V.drift(load(spark, d, "embeddings"), "label", "vec_id", "embedding").withColumn("cusum", F.round("cusum", 5))


@query(f"WITH {_UNIT} SELECT n.vec_id, min(o.vec_id) FILTER (list_dot_product(n.v, o.v) >= 0.4) AS duplicate_of FROM u n CROSS JOIN u o WHERE n.vec_id % 5 = 0 AND o.vec_id % 5 <> 0 GROUP BY 1")
def near_duplicate_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings")
    return V.near_existing(e.where("vec_id % 5 = 0"), e.where("vec_id % 5 <> 0"), 0.4)


@query()
def hdbscan_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters by density of the vectors' first two numbers, five or more; tests hold the labels against a plain version."""
    from ..operators import density

    e = load(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("embedding"))
    return density.hdbscan(e, 5)


@query()
def kmeans_clusters(spark: SparkSession, d: str) -> DataFrame:
    """As many clusters as the root of the number of vectors."""
    return V.kmeans(load(spark, d, "embeddings"), "vec_id", F.col("embedding"))


@query()
def kmeans_age_value(spark: SparkSession, d: str) -> DataFrame:
    """Events by age in days and value, as they are, in ten clusters."""
    e = load(spark, d, "events")
    age = F.unix_micros(F.lit(datetime(2024, 2, 1)).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return V.kmeans(e, "event_id", F.array(age / 86_400_000_000, F.col("value")), 10)


@query(r"""WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS ws FROM benchmark) SELECT item_id, CAST(len(ws) AS BIGINT) AS n_words FROM w""")
def benchmark_word_sets(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "benchmark").select("item_id", F.size(X.word_set(F.col("text"))).cast("long").alias("n_words"))
