"""Queries of readers and writers, which write a table and read it again, and of groups, routes and updates that other modules leave out."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup as D
from ..operators import quality as Q
from ..operators import search as S
from ..operators import sessions as N
from ..operators import vectors as V
from ..operators.graph import new_path
from ..sources import readers as R
from ..sources import sinks as W
from ..sources.tables import CANDLES_SQL, FACTS_SQL, MESSAGES_SQL, candles, facts, load, messages
from .registry import query


# Readers


def _dumped(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as a chat's dump: JSON lines, written and read again."""
    rows = load(spark, d, "conversations")
    role = F.col("role")
    attached = F.array(F.struct(F.lit("link").alias("type"), F.concat(F.lit("u/"), F.col("turn").cast("string")).alias("uri"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("map<string,string>").alias("metadata")))
    out = rows.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 86_400 + F.col("turn") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_utc"),
        F.struct(role.alias("id"), role.alias("username"), role.alias("display")).alias("from"),
        "text",
        F.when(F.col("turn") % 2 == 0, attached).alias("attachments"),
        F.struct(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("title")).alias("chat"),
    )
    path = new_path(spark)
    out.write.json(path)
    return R.chat_dump(spark, path)


_DUMP = "SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, 'c' || CAST(conv_id AS VARCHAR) AS title, TIMESTAMP '2024-01-01' + to_days(CAST(conv_id AS INTEGER)) + to_minutes(turn) AS ts, role, text, turn FROM conversations"


@query(f"SELECT id, title, ts, role AS username, text FROM ({_DUMP})")
def chat_dump_scan(spark: SparkSession, d: str) -> DataFrame:
    return _dumped(spark, d).select("id", F.col("chat.title").alias("title"), "ts", F.col("from.username").alias("username"), "text")


@query(f"SELECT 'chat:' || title || ':' || id AS record_id, 'chat' AS source, text AS content, ts, role AS author FROM ({_DUMP}) WHERE trim(coalesce(text, ''), ' ') <> ''")
def chat_records(spark: SparkSession, d: str) -> DataFrame:
    return R.records(_dumped(spark, d), "chat").select("record_id", "source", "content", "ts", "author")


@query(f"SELECT 'chat:' || title || ':' || id AS record_id, CASE WHEN turn % 2 = 0 THEN 'link' END AS type, CASE WHEN turn % 2 = 0 THEN 'u/' || CAST(turn AS VARCHAR) END AS uri FROM ({_DUMP}) WHERE trim(coalesce(text, ''), ' ') <> ''")
def attachment_rows(spark: SparkSession, d: str) -> DataFrame:
    return R.attachments(R.records(_dumped(spark, d), "chat")).select("record_id", "type", "uri")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def live_since(spark: SparkSession, d: str) -> DataFrame:
    return R.window(load(spark, d, "events"), since=datetime(2024, 1, 10)).select("event_id")


@query("SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-20' AND ts >= TIMESTAMP '2024-01-15' - INTERVAL 1 YEAR")
def live_before(spark: SparkSession, d: str) -> DataFrame:
    return R.window(load(spark, d, "events"), before=datetime(2024, 1, 20), as_of=datetime(2024, 1, 15)).select("event_id")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def live_last_n(spark: SparkSession, d: str) -> DataFrame:
    return R.last_n(load(spark, d, "events"), 100, "ts", "event_id").select("event_id", "ts")


@query(f"SELECT chat, max(ts) AS last, count(*) AS n FROM ({MESSAGES_SQL}) GROUP BY 1")
def indexed_high_water_marks(spark: SparkSession, d: str) -> DataFrame:
    """Of what a sink has after messages were appended to it, partitioned by chat."""
    path = new_path(spark)
    W.append(messages(spark, d), path, "chat")
    return R.high_water_mark(spark.read.parquet(path), "chat", "ts")


@query(f"SELECT symbol, ts, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, ts + INTERVAL 1 DAY AS close_time, CAST(volume AS BIGINT) AS trades FROM ({CANDLES_SQL})")
def kline_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Candles as arrays of text, as exchanges send them, and back."""
    millis = lambda t: F.unix_millis(t.cast("timestamp")).cast("string")
    text = lambda c: F.format_string("%.8f", F.col(c))
    ends = F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 DAY")
    sent = candles(spark, d).select("symbol", F.array(millis(F.col("ts")), *map(text, ("open", "high", "low", "close", "volume")), millis(ends), F.lit("0"), F.col("volume").cast("long").cast("string"), F.lit("0"), F.lit("0"), F.lit("0")).alias("kline"))
    found = R.klines(sent)
    price = lambda c: F.round(F.col(c).cast("double"), 6).alias(c)
    zone_free = lambda c: F.col(c).cast("timestamp_ntz")
    return found.select("symbol", zone_free("open_time").alias("ts"), *map(price, ("open", "high", "low", "close", "volume")), zone_free("close_time").alias("close_time"), "trades")


@query("SELECT CAST(o_custkey AS VARCHAR) AS symbol, CASE WHEN o_orderkey % 2 = 0 THEN 'bid' ELSE 'ask' END AS side, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_orderkey) - 1 AS level, round(o_totalprice, 4) AS price FROM orders")
def order_book_levels(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as a book: books are as long as exchanges send them, however many customers there are."""
    o = load(spark, d, "orders")
    level = F.struct("o_orderkey", F.format_string("%.8f", F.col("o_totalprice")).alias("p"))
    listed = lambda even: F.transform(F.array_sort(F.collect_list(F.when((F.col("o_orderkey") % 2 == 0) == F.lit(even), level))), lambda x: F.array(x["p"], F.lit("1")))
    books = o.groupBy(F.col("o_custkey").cast("string").alias("symbol")).agg(listed(True).alias("bids"), listed(False).alias("asks"))
    return R.order_book(books).select("symbol", "side", F.col("level").cast("long").alias("level"), F.round(F.col("price").cast("double"), 4).alias("price"))


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) ORDER BY p_retailprice DESC, p_partkey LIMIT 20")
def screener_scan(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part").withColumnRenamed("p_brand", "exchange")
    first = p.agg(F.min("exchange")).first()[0]
    return R.screener(p, ["p_partkey", "p_retailprice"], first, 20, F.desc("p_retailprice"), F.col("p_partkey"))


@query("SELECT DISTINCT trim(s_name) AS symbol FROM supplier WHERE trim(s_name) <> ''")
def symbol_list(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark)
    load(spark, d, "supplier").select(F.concat(F.lit(" "), "s_name", F.lit("  ")).alias("value")).write.text(path)
    return R.symbols(spark, path).distinct()


@query("SELECT CAST(item_id AS VARCHAR) AS record_id, 'bench' AS source, replace(text, chr(10), ' ') AS content, TIMESTAMP '2024-05-05' AS ts, 'a' AS author, len(string_split(CASE WHEN item_id % 2 = 0 THEN 'x,y' ELSE 'x' END, ',')) AS n_tags FROM benchmark")
def imported_records(spark: SparkSession, d: str) -> DataFrame:
    """Records as CSV, without times, and as a table again."""
    path = new_path(spark)
    tags = F.when(F.col("item_id") % 2 == 0, "x, y").otherwise("x,")
    rows = load(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("record_id"), F.lit("bench").alias("source"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("content"), F.lit("").alias("timestamp"), F.lit("a").alias("author"), tags.alias("tags"))
    rows.write.option("header", True).csv(path)
    out = R.import_records(spark, path, "csv", datetime(2024, 5, 5))
    return out.select("record_id", "source", "content", F.col("ts").cast("timestamp_ntz").alias("ts"), "author", F.size("tags").cast("long").alias("n_tags"))


# Writers


@query(f"SELECT chat, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM ({MESSAGES_SQL}) GROUP BY 1, 2")
def daily_json_append(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark)
    W.daily_json(messages(spark, d), path, "chat", "ts")
    back = spark.read.schema("id long, author long, ts string, text string, chat string, day string").json(path)
    return back.groupBy("chat", "day").agg(F.count("*").alias("n"))


@query(f"SELECT kind, CAST(id AS BIGINT) AS id, value FROM ({FACTS_SQL})")
def fact_insert(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark)
    W.append(facts(spark, d), path, "kind")
    return spark.read.parquet(path).select("kind", "id", "value")


@query("SELECT event_type, event_id, value FROM events")
def metric_insert(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark)
    W.append(load(spark, d, "events"), path)
    return spark.read.parquet(path).select("event_type", "event_id", "value")


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def aggregate_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The first write has wrong sums of one type; the second puts that type's partition right, and is sent twice."""
    path = new_path(spark)
    sums = load(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    W.replace_partitions(sums.withColumn("n", F.when(F.col("event_type") == "click", -1).otherwise(F.col("n")).cast("long")), path, "event_type")
    for _ in range(2):
        W.replace_partitions(sums.where("event_type = 'click'"), path, "event_type")
    return spark.read.schema(sums.schema).parquet(path).select("event_type", "user_id", "n")


@query("SELECT CAST(doc_id AS VARCHAR) AS record_id, source, n_chars AS ts FROM documents WHERE source = (SELECT min(source) FROM documents) AND lang = 'en' ORDER BY doc_id LIMIT 20")
def json_export(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark)
    docs = load(spark, d, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("record_id"), "source", F.col("n_chars").alias("ts"), F.array("lang").alias("tags"), F.col("text").alias("content"), "doc_id")
    W.export(rows, path, "json", source=docs.agg(F.min("source")).first()[0], tags=["en"], n=20, order=["doc_id"])
    return spark.read.schema("record_id string, source string, ts long").json(path)


@query("SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 5 <> 1")
def delete_by_chat(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier")
    own = F.col("s_suppkey") % 5 == 1
    n = F.col("s_suppkey").cast("string")
    key = F.when(own & (F.col("s_suppkey") % 3 == 0), F.concat(F.lit("m:work:"), n)).otherwise(n)
    nodes = s.select("s_suppkey", key.alias("id"), F.when(own & (F.col("s_suppkey") % 3 == 1), F.array(F.lit("work"))).alias("tags"), F.when(own & (F.col("s_suppkey") % 3 == 2), '{"chat": "work"}').alias("properties"))
    return W.without_chat(nodes, "work").select(F.col("s_suppkey").alias("id"))


# Groups of messages


_DAYS = f"""m AS (SELECT *, coalesce(date_sub('microsecond', lag(ts) OVER w, ts) > 14400000000, false)::INT AS b FROM ({MESSAGES_SQL}) WINDOW w AS (PARTITION BY chat ORDER BY ts, id)),
  g AS (SELECT *, sum(b) OVER (PARTITION BY chat ORDER BY ts, id) AS s FROM m)"""


@query(f"WITH {_DAYS} SELECT id, chat, CAST(s AS BIGINT) AS session_no FROM g")
def day_group_breaks(spark: SparkSession, d: str) -> DataFrame:
    return N.day_groups(messages(spark, d), "chat", "ts", "id").select("id", "chat", F.col("session_no").cast("long").alias("session_no"))


@query(f"WITH {_DAYS} SELECT id, chat, CAST(coalesce(lag(s) OVER (PARTITION BY chat ORDER BY ts, id), 0) AS BIGINT) AS session_no FROM g")
def day_group_breaks_late(spark: SparkSession, d: str) -> DataFrame:
    return N.day_groups(messages(spark, d), "chat", "ts", "id", late=True).select("id", "chat", F.col("session_no").cast("long").alias("session_no"))


@query(f"""WITH m AS (SELECT *, hour(ts) AS h FROM ({MESSAGES_SQL})), c AS (SELECT chat, h, count(*) AS n FROM m GROUP BY 1, 2), t AS (SELECT chat, list(h) AS top FROM (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY n DESC, h) AS p FROM c) WHERE p <= 3 GROUP BY 1),
  q AS (SELECT m.*, top, lag(h) OVER (PARTITION BY m.chat ORDER BY ts, id) AS p FROM m JOIN t ON t.chat = m.chat)
  SELECT id, chat, CAST(sum(coalesce((h < 9 AND p >= 9) OR (list_contains(top, p) AND NOT list_contains(top, h)), false)::INT) OVER (PARTITION BY chat ORDER BY ts, id) AS BIGINT) AS session_no FROM q""")
def pattern_split_sessions(spark: SparkSession, d: str) -> DataFrame:
    return N.pattern_split(messages(spark, d), "chat", "ts", "id").select("id", "chat", "session_no")


@query(f"""WITH p AS (SELECT id, chat, CAST(floor((row_number() OVER (PARTITION BY chat ORDER BY ts, id) - 1) / 30) AS BIGINT) AS part_no FROM ({MESSAGES_SQL}))
  SELECT id, chat, part_no FROM (SELECT *, count(*) OVER (PARTITION BY chat, part_no) AS n FROM p) WHERE n >= 20""")
def embedding_parts(spark: SparkSession, d: str) -> DataFrame:
    return N.embedding_groups(messages(spark, d), "chat", ["ts", "id"], 30, 20).select("id", "chat", F.col("part_no").cast("long").alias("part_no"))


@query(f"""
WITH RECURSIVE m AS (
  SELECT chat, strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, length(text) AS size,
         row_number() OVER (PARTITION BY chat, date_trunc('week', ts) ORDER BY ts, id) AS k FROM ({MESSAGES_SQL})),
  r AS (
  SELECT chat, period, k, size AS held, size, 0 AS part_no FROM m WHERE k = 1
  UNION ALL
  SELECT m.chat, m.period, m.k, CASE WHEN held + m.size > 2000 THEN m.size ELSE held + m.size END, m.size, CASE WHEN held + m.size > 2000 THEN part_no + 1 ELSE part_no END
  FROM r JOIN m ON m.chat = r.chat AND m.period = r.period AND m.k = r.k + 1)
SELECT chat, period, CAST(part_no AS BIGINT) AS part_no, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM r GROUP BY ALL""")
def hybrid_windows(spark: SparkSession, d: str) -> DataFrame:
    """The parts of weeks, cut where they pass a budget."""
    rows = messages(spark, d).withColumn("size", F.length("text").cast("long"))
    parts = N.hybrid_groups(rows, "chat", "ts", "size", "id", window="week", most=2000)
    return parts.select("chat", "period", F.col("part_no").cast("long").alias("part_no"), F.col("n").cast("long").alias("n"), F.col("size").cast("long").alias("size"))


@query(f"SELECT id, (date_sub('second', p, ts) > 86400) OR (CAST(p AS DATE) <> CAST(ts AS DATE) AND date_sub('second', p, ts) > 7200) AS is_new FROM (SELECT id, ts, lag(ts) OVER (PARTITION BY chat ORDER BY ts, id) AS p FROM ({MESSAGES_SQL})) WHERE p IS NOT NULL")
def new_day_rule(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = messages(spark, d).withColumn("p", F.lag("ts").over(Window.partitionBy("chat").orderBy("ts", "id"))).where("p is not null")
    return rows.select("id", N.new_day(F.col("p"), F.col("ts")).alias("is_new"))


# Routes, weights, updates


def _scores(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return load(spark, d, "events").where(F.col("event_type") == kind).groupBy(F.col("user_id").alias("id")).agg(F.max("value").alias("score"))


_SCORE = "SELECT user_id AS id, max(value) AS score FROM events WHERE event_type = '{}' GROUP BY 1"


@query(f"SELECT id, round(sum(s), 8) AS score FROM (SELECT id, score * 0.4::DOUBLE AS s FROM ({_SCORE.format('view')}) UNION ALL SELECT id, score * 0.6::DOUBLE FROM ({_SCORE.format('click')})) GROUP BY 1 ORDER BY sum(s) DESC, id LIMIT 20")
def intent_weights(spark: SparkSession, d: str) -> DataFrame:
    return S.intent_weighted(_scores(spark, d, "view"), _scores(spark, d, "click"), "analytical").select("id", F.round("score", 8).alias("score"))


@query(f"SELECT id, round(score, 8) AS score FROM ({_SCORE.format('click')}) ORDER BY score DESC, id LIMIT 10")
def routed_text_search(spark: SparkSession, d: str) -> DataFrame:
    return S.routed("text", words=_scores(spark, d, "click"), vectors=_scores(spark, d, "view")).select("id", F.round("score", 8).alias("score"))


@query(f"SELECT id FROM (SELECT id FROM ({_SCORE.format('view')}) ORDER BY score DESC, id LIMIT 50) WHERE id % 3 = 0")
def filter_after_cut(spark: SparkSession, d: str) -> DataFrame:
    records = load(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    return S.after_cut(_scores(spark, d, "view"), records, F.col("id") % 3 == 0, 50).select("id")


@query("SELECT c_custkey, round(CASE WHEN m > 0 THEN c_acctbal / m * 2 ELSE 0 END, 8) AS score FROM customer, (SELECT max(c_acctbal) AS m FROM customer)")
def max_normalised_scores(spark: SparkSession, d: str) -> DataFrame:
    return S.max_normalised(load(spark, d, "customer"), {"c_acctbal": 2.0}).select("c_custkey", F.round("score", 8).alias("score"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'moved' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def batch_update(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    changes = c.where("c_custkey % 4 = 0").select("c_custkey", F.lit("moved").alias("c_mktsegment")).union(spark.createDataFrame([(-1, "x")], "c_custkey long, c_mktsegment string"))
    return D.update_with_status(c, changes, "c_custkey")[0]


@query("SELECT c_custkey, 'updated' AS status FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT -1, 'missing'")
def batch_update_status(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").select("c_custkey", "c_mktsegment")
    changes = c.where("c_custkey % 4 = 0").select("c_custkey", F.lit("moved").alias("c_mktsegment")).union(spark.createDataFrame([(-1, "x")], "c_custkey long, c_mktsegment string"))
    return D.update_with_status(c, changes, "c_custkey")[1]


@query("SELECT label, vec_id FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) BETWEEN 2 AND 50)")
def sized_clusters(spark: SparkSession, d: str) -> DataFrame:
    return V.sized_clusters(load(spark, d, "embeddings"), "label").select("label", "vec_id")


@query()
def resized_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Labels as clusters, those of more than 20 split: every vector once. Tests check sizes and members."""
    return V.resized(load(spark, d, "embeddings"), "label", most=20).select("vec_id", "cluster")


# Exchange snapshots, archives, summaries


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """Parts as an exchange's day statistics: JSON of text figures."""
    text = lambda c: F.col(c).cast("string")
    body = F.to_json(F.struct(
        F.concat(F.lit("P"), text("p_partkey")).alias("symbol"), text("p_retailprice").alias("lastPrice"), F.lit("-1.5").alias("priceChange"), F.lit("x").alias("priceChangePercent"),
        text("p_retailprice").alias("highPrice"), text("p_size").alias("volume"), text("p_size").alias("quoteVolume"), F.col("p_size").alias("count"), text("p_size").alias("openInterest"),
    ))
    return load(spark, d, "part").select(F.concat(F.lit("P"), text("p_partkey")).alias("symbol"), body.alias("body"), F.lit(datetime(2024, 3, 1)).cast("timestamp_ntz").alias("ts"))


@query("SELECT 'P' || CAST(p_partkey AS VARCHAR) AS symbol, p_retailprice AS price, -1.5::DOUBLE AS price_change, NULL::DOUBLE AS price_change_percent, p_retailprice AS high, NULL::DOUBLE AS low, p_size::DOUBLE AS volume, p_size::DOUBLE AS quote_volume, p_size::BIGINT AS trade_count FROM part")
def day_tickers(spark: SparkSession, d: str) -> DataFrame:
    return R.tickers(_bodies(spark, d))


@query("SELECT 'P' || CAST(p_partkey AS VARCHAR) AS symbol, p_size::DOUBLE AS open_interest, NULL::DOUBLE AS funding_rate, p_size::DOUBLE AS cvd, TIMESTAMP '2024-03-01' AS ts FROM part")
def derivative_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return R.derivatives(_bodies(spark, d))


_TRADES = "SELECT o_orderpriority AS symbol, o_orderkey AS trade_id, o_totalprice AS price FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')"


def _trades(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderkey").alias("trade_id"), F.col("o_totalprice").alias("price"))


@query(f"SELECT symbol, trade_id, price FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_id DESC) AS p FROM ({_TRADES})) WHERE p <= 20")
def public_trades_batch(spark: SparkSession, d: str) -> DataFrame:
    return R.symbols_batch(_trades(spark, d), ["1-urgent", "5-LOW", "1-URGENT"], 20, F.desc("trade_id"))


@query(f"SELECT symbol, ts, close FROM ({CANDLES_SQL}) WHERE symbol IN ('1-URGENT', '2-HIGH')")
def klines_batch(spark: SparkSession, d: str) -> DataFrame:
    return R.symbols_batch(candles(spark, d), ["1-urgent", "2-high"]).select("symbol", "ts", "close")


@query("SELECT 'v' || CAST(vec_id AS VARCHAR) AS text, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings")
def archive_restore(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark)
    e = load(spark, d, "embeddings")
    e.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("text"), "embedding").write.json(path)
    back = R.restored(spark, path, 64)
    return back.select("text", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


@query("SELECT count(value) AS n, round(avg(value), 3) AS average, round(min(value), 3) AS least, round(max(value), 3) AS largest FROM events")
def importance_summary(spark: SparkSession, d: str) -> DataFrame:
    return Q.importance_summary(load(spark, d, "events"), "value")


@query("""WITH f AS (SELECT user_id, count(*) AS n, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1)
  SELECT user_id, n, first, last, round(last - first, 6) AS change, CASE WHEN last > first THEN 'improved' WHEN last < first THEN 'declined' ELSE 'stable' END AS trend FROM f""")
def analysis_comparison(spark: SparkSession, d: str) -> DataFrame:
    return Q.comparison(load(spark, d, "events"), "user_id", "ts", "value", "event_id").withColumn("change", F.round("change", 6))


@query(f"""
WITH RECURSIVE m AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM ({MESSAGES_SQL})),
  g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) > 14400000000 THEN 1 ELSE 0 END AS nw FROM m WINDOW w AS (PARTITION BY chat, day ORDER BY ts, id)),
  s AS (SELECT *, sum(nw) OVER (PARTITION BY chat, day ORDER BY ts, id) AS natural_no FROM g),
  p AS (SELECT chat, day, natural_no, count(*) AS n, min(ts) AS b, max(ts) AS e, row_number() OVER (PARTITION BY chat, day ORDER BY natural_no) AS k FROM s GROUP BY chat, day, natural_no),
  r AS (
  SELECT chat, day, k, n, b, e, n AS held, 1 AS part_no FROM p WHERE k = 1
  UNION ALL
  SELECT p.chat, p.day, p.k, p.n, p.b, p.e, CASE WHEN held >= 5 THEN p.n ELSE held + p.n END, CASE WHEN held >= 5 THEN part_no + 1 ELSE part_no END
  FROM r JOIN p ON p.chat = r.chat AND p.day = r.day AND p.k = r.k + 1)
SELECT chat, day, CAST(part_no AS INTEGER) AS part_no, chat || '-' || day || '-' || lpad(CAST(part_no AS VARCHAR), 2, '0') AS child_id,
       CAST(sum(n) AS BIGINT) AS n, min(b) AS start, max(e) AS "end" FROM r GROUP BY ALL""")
def expanded_day_groups(spark: SparkSession, d: str) -> DataFrame:
    """The parts of each day."""
    parts = N.expanded_days(messages(spark, d), "chat", "ts", "id")
    return parts.select("chat", "day", "part_no", "child_id", F.col("n").cast("long").alias("n"), "start", "end")


@query(f"""
SELECT symbol, ts, round(open, 5) AS open, round(high, 5) AS high, round(low, 5) AS low, round(close, 5) AS close, volume
FROM ({CANDLES_SQL}) WHERE symbol IN ('1-URGENT', '2-HIGH', '5-LOW') AND close > 1100""")
def klines_source(spark: SparkSession, d: str) -> DataFrame:
    """Candles written as arrays, a file for each symbol and task, and read again through the data source: three symbols' files are opened."""
    from ..sources import klines

    at, path = F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), new_path(spark)
    row = F.array(at, *(F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")))
    month = F.date_trunc("month", F.col("ts").cast("timestamp"))
    sent = candles(spark, d).groupBy("symbol", month.alias("month")).agg(F.to_json(F.collect_list(row)).alias("value"))
    sent.select("value", "symbol", F.lit("1d").alias("interval")).write.partitionBy("symbol", "interval").text(path)
    klines.register(spark)
    found = spark.read.format("klines").option("glob", "*.txt").load(path).where(F.col("symbol").isin("1-URGENT", "2-HIGH", "5-LOW") & (F.col("close") > 1100))
    return found.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *(F.round(c, 5).alias(c) for c in ("open", "high", "low", "close")), "volume")
