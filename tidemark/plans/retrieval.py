"""Queries of graph-aware retrieval, screeners and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import market as M
from ..operators import graph as G
from ..operators import learning as L
from ..operators import quality as Q
from ..operators import retrieval as R
from ..operators import screeners as C
from ..operators import sessions as N
from ..sources.tables import CANDLES_SQL, MESSAGES_SQL, SIGNALS_SQL, candles, load, messages, signals
from .graph import _FLOW, _flow
from .registry import query


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy((F.col("user_id") % 200).alias("id")).agg(F.round(F.avg("value") / 100, 6).alias("score"), F.max("ts").alias("ts"))


_CAND = "SELECT user_id % 200 AS id, round(avg(value) / 100, 6) AS score, max(ts) AS ts FROM events GROUP BY 1"


@query()
def retrieval_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Candidates, the graph that they span, beams and a choice of unlike ones; tests hold it against a plain version."""
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = R.composed(_flow(spark, d), _candidates(spark, d).join(vectors, "id"))
    return found.withColumns({"fast": F.round("fast", 6), "final": F.round("final", 6)})


@query()
def retrieval_scores(spark: SparkSession, d: str) -> DataFrame:
    """The best candidates by the weighted score alone."""
    return R.retrieval(_flow(spark, d), _candidates(spark, d)).withColumn("final", F.round("final", 6))


@query()
def personalised_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return R.personalised_pagerank(_flow(spark, d), _candidates(spark, d)).withColumn("ppr", F.round("ppr", 6))


@query()
def beam_search(spark: SparkSession, d: str) -> DataFrame:
    return R.beam(_flow(spark, d), _candidates(spark, d))


@query(f"""WITH RECURSIVE e AS ({_FLOW}), b AS (SELECT source_id AS x, target_id AS y FROM e UNION SELECT target_id, source_id FROM e), r AS (SELECT range AS seed, range AS id, 0 AS h FROM range(0, 200, 20) UNION SELECT seed, y, h + 1 FROM r JOIN b ON x = id WHERE h < 2), m AS (SELECT id, min(h) AS h FROM (SELECT seed, id, min(h) AS h FROM r GROUP BY 1, 2) WHERE h > 0 GROUP BY 1), c AS ({_CAND})
  SELECT id, round(score * CASE h WHEN 1 THEN 1.3 WHEN 2 THEN 1.2 ELSE 1 END + coalesce(0.1 / h, 0), 6) AS score FROM c LEFT JOIN m USING (id)""")
def graph_boost(spark: SparkSession, d: str) -> DataFrame:
    hops = G.k_hop(_flow(spark, d), spark.range(0, 200, 20), 2)
    # a seed is at no hops; a longer way back to it doesn't count
    return R.boost(_candidates(spark, d), hops).withColumn("score", F.round("score", 6))


@query(f"WITH e AS ({_FLOW}), b AS (SELECT source_id AS id, target_id AS neighbor, weight FROM e UNION ALL SELECT target_id, source_id, weight FROM e), m AS (SELECT id, neighbor, max(weight) AS weight FROM b WHERE id % 20 = 0 GROUP BY 1, 2) SELECT id, neighbor, round(weight, 6) AS weight, CAST(p AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, neighbor) AS p FROM m) WHERE p <= 5")
def related_entities(spark: SparkSession, d: str) -> DataFrame:
    return R.related(_flow(spark, d), spark.range(0, 200, 20)).withColumn("weight", F.round("weight", 6))


@query(f"WITH e AS ({_FLOW}), b AS (SELECT source_id AS id, target_id AS n, weight FROM e UNION ALL SELECT target_id, source_id, weight FROM e), m AS (SELECT id, n, max(weight) AS w FROM b WHERE id < 25 AND weight > 0.3 GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, n) AS p FROM m), l AS (SELECT id, string_agg('n' || CAST(n AS VARCHAR), ' ' ORDER BY p) AS more FROM p WHERE p <= 5 GROUP BY 1) SELECT n_nationkey AS query_id, n_name || coalesce(' ' || more, '') AS text FROM nation LEFT JOIN l ON l.id = n_nationkey")
def query_expansion(spark: SparkSession, d: str) -> DataFrame:
    asked = load(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.col("n_nationkey").cast("long").alias("entity"), F.col("n_name").alias("text"))
    labels = spark.range(0, 200).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("label"))
    return R.expanded(asked, _flow(spark, d), labels)


@query()
def explain_chain(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.when(F.col("target_id") % 3 == 0, "TEMPORAL").when(F.col("target_id") % 3 == 1, "MENTIONS").otherwise("SIMILAR")
    return R.explain(spark.range(0, 200), _flow(spark, d).withColumn("type", kinds))


@query("SELECT DISTINCT * FROM (SELECT 'turn' || CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS source_id, 'conv' || CAST(conv_id AS VARCHAR) AS target_id, 'PART_OF' AS type FROM conversations WHERE turn < 10 UNION ALL SELECT 'conv' || CAST(conv_id AS VARCHAR), role, 'MENTIONS' FROM conversations WHERE turn < 10)")
def graph_from_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "conversations").select(F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("session"), F.concat(F.lit("turn"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("chunk"), (F.col("turn") + 1).alias("place"), F.array("role").alias("entities"))
    return R.from_sessions(rows).select("source_id", "target_id", "type")


@query(f"""WITH m AS ({MESSAGES_SQL}), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY ts DESC, id) AS p FROM m WHERE ts < TIMESTAMP '2024-01-28') WHERE p <= 50), n AS (SELECT * FROM m WHERE ts >= TIMESTAMP '2024-01-28'),
  j AS (SELECT n.id AS source_id, o.id AS target_id, CASE WHEN abs(date_sub('second', o.ts, n.ts)) <= 86400 THEN 0.6 WHEN n.author = o.author THEN 0.4 END::DOUBLE AS weight, o.ts FROM n JOIN o USING (chat))
  SELECT source_id, target_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, ts DESC, target_id) AS p FROM j WHERE weight IS NOT NULL) WHERE p <= 20""")
def link_to_existing(spark: SparkSession, d: str) -> DataFrame:
    from datetime import datetime

    m, cut = messages(spark, d), F.lit(datetime(2024, 1, 28))
    return R.link_existing(m.where(F.col("ts") >= cut), m.where(F.col("ts") < cut), ["chat"], "id", "ts", "author").select("source_id", "target_id", "weight")


@query("SELECT doc_id, round(1 / (1 + sqrt(1 - (n_chars % 100) / 100)), 8) AS similarity FROM documents")
def summary_similarity(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.round(R.score_similarity(F.col("n_chars") % 100 / 100), 8).alias("similarity"))


@query(f"WITH f AS (SELECT symbol, strftime(ts, '%Y-%m') AS timeframe, arg_min(open, ts) AS o, arg_max(close, ts) AS c FROM ({CANDLES_SQL}) GROUP BY 1, 2) SELECT symbol, count(*) FILTER (abs((c - o) / o * 100) >= 5) AS hits FROM f GROUP BY 1 HAVING count(*) FILTER (abs((c - o) / o * 100) >= 5) >= 3")
def multi_timeframe_pattern(spark: SparkSession, d: str) -> DataFrame:
    frames = candles(spark, d).groupBy("symbol", F.date_format("ts", "yyyy-MM").alias("timeframe")).agg(F.min_by("open", "ts").alias("open"), F.max_by("close", "ts").alias("close"))
    return C.multi_timeframe(frames, 5, 3)


@query()
def trend_breakout_screener(spark: SparkSession, d: str) -> DataFrame:
    return C.trend_breakout(candles(spark, d)).select("symbol", "ts", "level", F.round("pct_b", 6).alias("pct_b"))


@query()
def pullback_screener(spark: SparkSession, d: str) -> DataFrame:
    return C.pullback(candles(spark, d)).select("symbol", "ts", "level", F.round("rsi", 4).alias("rsi"))


@query()
def coin_analysis(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import market as K

    df = K.bollinger(K.smoothed(candles(spark, d))).where("basis is not null")
    return df.select("symbol", "ts", Q.coin_labels(F.col("rsi"), F.col("adx"), F.col("atr") / F.col("close"), F.col("close"), F.col("upper"), F.col("lower")).alias("labels")).select("symbol", "ts", "labels.*")


@query("SELECT p_partkey, p_brand AS asset, p_size AS amount, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 1.0 ELSE p END::DOUBLE AS price, round(p_size * CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 1.0 ELSE p END::DOUBLE + 1e-7, 4) AS value FROM part LEFT JOIN (SELECT p_brand AS b, max(p_retailprice) AS p FROM part WHERE p_size > 20 GROUP BY 1) ON b = p_brand WHERE p_brand IN ('Brand#1', 'Brand#2') OR p IS NOT NULL")
def balances_at_prices(spark: SparkSession, d: str) -> DataFrame:
    part = load(spark, d, "part")
    prices = part.where("p_size > 20").groupBy(F.col("p_brand").alias("asset")).agg(F.max("p_retailprice").alias("price"))
    rows = part.select(F.col("p_brand").alias("asset"), F.struct("p_partkey", "p_size").alias("k"), F.col("p_size").alias("amount"))
    keyed = rows.select("asset", "k", "amount")
    joined = keyed.join(C.priced(keyed.select("asset", F.lit(1).alias("amount")).distinct(), prices, ("Brand#1", "Brand#2")).select("asset", "price"), "asset")
    return joined.select("k.p_partkey", "asset", "amount", "price", F.round(F.col("amount") * F.col("price") + 1e-7, 4).alias("value"))


@query(f"SELECT signal_id, round(CASE WHEN signal_id % 2 = 0 THEN entry * 1.01 * (1 + CASE WHEN direction = 'long' THEN -1 ELSE 1 END * 1.5 / 100) ELSE entry * (1 + CASE WHEN direction = 'long' THEN -1 ELSE 1 END * 2.0 / 100) END + 1e-7, 3) AS stop FROM ({SIGNALS_SQL}) WHERE direction IS NOT NULL")
def stop_prices(spark: SparkSession, d: str) -> DataFrame:
    s = signals(spark, d).where("direction is not null")
    stop = M.stop_price(F.col("entry") * 1.01, F.col("entry"), F.col("direction"), F.when(F.col("signal_id") % 2 == 0, 1.5), F.lit(2.0))
    return s.select("signal_id", F.round(stop + 1e-7, 3).alias("stop"))


@query("SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS symbol, 'price_level' AS kind, s_acctbal AS value FROM supplier WHERE s_acctbal >= 5000 UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'drawdown', (s_suppkey % 30 - 20)::DOUBLE FROM supplier WHERE s_suppkey % 30 - 20 <= -10 UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), 'rsi_extreme', (s_suppkey % 100)::DOUBLE FROM supplier WHERE s_suppkey % 100 >= 80 OR s_suppkey % 100 <= 20")
def portfolio_alerts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    rows = load(spark, d, "supplier").select(F.concat(F.lit("S"), k.cast("string")).alias("symbol"), (k % 30 - 20).alias("drawdown"), F.lit(0).alias("profit"), F.lit(0).alias("volume_ratio"), F.col("s_acctbal").alias("price"), (k % 100).alias("rsi"))
    rules = spark.createDataFrame([("price_level", 5000.0), ("drawdown", 10.0), ("rsi_extreme", 80.0)], "kind string, threshold double")
    return C.alert_thresholds(rows, rules)


@query(f"WITH d AS (SELECT chat, strftime(ts, '%Y-%m-%d') AS day, id, ts FROM ({MESSAGES_SQL})), h AS (SELECT *, date_sub('second', min(ts) OVER w, max(ts) OVER w) / 3600 AS h, count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY chat, day)), p AS (SELECT *, floor(h / 6) + 1 AS parts, row_number() OVER (PARTITION BY chat, day ORDER BY ts, id) AS k FROM h) SELECT id, CAST(least(floor((k - 1) / greatest(floor(n / parts), 1)), parts - 1) AS BIGINT) AS part_no FROM p")
def split_long_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return N.split_long(rows, ["chat", "day"], "ts", "id").select("id", F.col("part_no").cast("long").alias("part_no"))


@query("SELECT 'p' || CAST(c_custkey % 5 AS VARCHAR) AS profile_id, c_mktsegment AS experiment, round(max(c_acctbal), 2) AS weight FROM customer GROUP BY 1, 2")
def experiment_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "customer").groupBy(F.concat(F.lit("p"), (F.col("c_custkey") % 5).cast("string")).alias("profile_id"), "c_mktsegment").agg(F.round(F.max("c_acctbal"), 2).alias("w"))
    profiles = rows.groupBy("profile_id").agg(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "w"))).alias("experiments"))
    return L.experiments(profiles)


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, count(*) AS n FROM conversations GROUP BY 1")
def nested_session(spark: SparkSession, d: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return load(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("t"), F.count("*").alias("n")).select("conv_id", F.concat_ws(",", F.transform("t", lambda x: x["role"])).alias("roles"), "n")


@query("SELECT k AS problem, CAST(sum(v) AS BIGINT) AS total, count(*) AS queries, round(avg(s), 6) AS mean_score FROM (SELECT event_type AS k, CAST(user_id % 3 AS BIGINT) AS v, value AS s FROM events WHERE user_id % 3 > 0) GROUP BY 1")
def problem_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").select(F.create_map("event_type", (F.col("user_id") % 3)).alias("problems"), "value")
    long = rows.select(F.explode("problems").alias("problem", "v"), "value").where("v > 0")
    return long.groupBy("problem").agg(F.sum("v").alias("total"), F.count("*").alias("queries"), F.round(F.avg("value"), 6).alias("mean_score"))


@query("SELECT source, count(*) AS n_records, count(DISTINCT lang) AS langs, min(doc_id) AS first, max(doc_id) AS last FROM documents GROUP BY 1")
def chat_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n_records"), F.count_distinct("lang").alias("langs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


@query(f"SELECT chat, count(DISTINCT author) AS threads, round(count(DISTINCT CASE WHEN id % 3 = 0 THEN id END) / count(*), 6) AS coverage FROM ({MESSAGES_SQL}) GROUP BY 1")
def coverage_and_threads(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).groupBy("chat").agg(F.count_distinct("author").alias("threads"), F.round(F.count_distinct(F.when(F.col("id") % 3 == 0, F.col("id"))) / F.count("*"), 6).alias("coverage"))
