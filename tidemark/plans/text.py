"""Queries over messages and documents: cleaning, extraction, deduplication, importance."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import time as TM
from ..operators import dedup as D
from ..sources.tables import MESSAGES_SQL, load, messages
from .registry import query

AS_OF = datetime(2024, 1, 31)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages")


_NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(coalesce({c}, ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&'), '<[^>]+>', '', 'g'), '(?i)\[(?:source|date):[^\]]*\]', '', 'g'), '[\x{{1f1e0}}-\x{{1f6ff}}\x{{1f300}}-\x{{1f5ff}}\x{{1f900}}-\x{{1f9ff}}\x{{1fa70}}-\x{{1faff}}\x{{2700}}-\x{{27bf}}]', '', 'g'), '\s+', ' ', 'g'))"""


@query(f"SELECT page_id, md5({_NORM.format(c='html')}) AS digest, length({_NORM.format(c='html')}) AS n FROM pages")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", X.normalize(F.col("html")).alias("t")).select("page_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("long").alias("n"))


@query(f"SELECT doc_id, CAST(len(list_filter(string_split({_NORM.format(c='text')}, ' '), lambda x: x <> '')) AS BIGINT) AS n_tokens FROM documents")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(r"""SELECT page_id, list_distinct(regexp_extract_all(html, 'https?://[^\s<>"{}|\\^`\[\]]+')).len() AS n_urls, CAST(len(list_distinct(list_transform(regexp_extract_all(html, '@([0-9A-Za-z_]+)', 1), lambda x: lower(x)))) AS BIGINT) AS n_mentions FROM pages""")
def extract_urls_mentions(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return _pages(spark, d).select("page_id", F.size(X.urls(h)).cast("long").alias("n_urls"), F.size(X.mentions(h)).cast("long").alias("n_mentions"))


@query(r"""SELECT page_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(html, 'https?://[^\s<>"{}|\\^`\[\]]+'), lambda u: regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), lambda x: x <> ''))) AS domains FROM pages""")
def extract_domains(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", F.array_sort(X.domains(X.urls(F.col("html")))).alias("domains"))


@query(r"""
WITH n AS (
  SELECT doc_id, regexp_extract_all(text, '(?i)\b(\d+(?:[.,]\d+)?)\s*([%$€₽¥£]|USD|EUR|RUB|TON|BTC|ETH)?\b', 1) AS originals,
         list_filter(regexp_extract_all(text, '(?i)\b(\d+(?:[.,]\d+)?)\s*([%$€₽¥£]|USD|EUR|RUB|TON|BTC|ETH)?\b', 2), lambda x: x <> '') AS units,
         regexp_extract_all(text, '(?i)\b[\w\-]+\.(jpg|jpeg|png|gif|pdf|doc|docx|xls|xlsx|zip|rar|mp4|mp3|wav)\b') AS files FROM documents)
SELECT doc_id, originals, units, list_max(list_transform(originals, lambda x: CAST(replace(x, ',', '.') AS DOUBLE))) AS largest, list_sort(list_distinct(files)) AS files FROM n
""")
def extract_numbers_files(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    found = load(spark, d, "documents").select("doc_id", X.numbers(t).alias("n"), F.array_sort(X.files(t)).alias("files"))
    largest = F.array_max(F.transform("n", lambda x: x["value"]))
    units = F.array_compact(F.transform("n", lambda x: x["unit"]))
    return found.select("doc_id", F.transform("n", lambda x: x["original"]).alias("originals"), units.alias("units"), largest.alias("largest"), "files")


@query()
def extract_entities(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return load(spark, d, "documents").select(
        "doc_id", X.mentions(t).alias("mentions"), X.tickers(t, ["BTC", "ETH", "TON", "SOL"]).alias("tickers"), X.urls(t).alias("urls"), X.dates(t).alias("dates"), X.times(t).alias("times"),
        X.numbers(t).alias("numbers"), X.files(t).alias("files"), X.crypto_addresses(t).alias("crypto"), X.telegram(t).alias("telegram"),
    )


@query("""SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[А-Яа-яЁё]')) > len(regexp_extract_all(text, '[A-Za-z]')) THEN 'ru' WHEN len(regexp_extract_all(text, '[A-Za-z]')) > 0 THEN 'en' END AS language FROM documents""")
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", X.language(F.col("text")).alias("language"))


@query("""SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM customer""")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select("c_custkey", X.slug(F.col("c_name")).alias("slug"))


@query("""SELECT page_id, CASE WHEN regexp_matches(trim(url), '^https?://(?:\\[[0-9A-Fa-f:.]+\\]|[^\\s/\\[\\]]+)(?:[/?#]\\S*)?$') THEN trim(url) END AS url FROM pages""")
def clean_url(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", X.clean_url(F.col("url")).alias("url"))


@query("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE substr(text, 1, 77) || '...' END AS short FROM documents")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", X.truncate(F.col("text"), 80).alias("short"))


@query(r"""WITH w AS (SELECT doc_id, lower(text) AS low, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS ws FROM documents),
  c AS (SELECT *, (list_contains(ws, 'the')::INT + list_contains(ws, 'tion')::INT) AS hit, (length(low) - length(replace(low, 'the', ''))) / 3 + (length(low) - length(replace(low, 'tion', ''))) / 4 AS cnt FROM w)
  SELECT doc_id, round(CASE WHEN hit = 0 THEN 0 ELSE least(1, (hit / 2 * 0.6 + least(1, cnt / greatest(len(ws), 1)) * 0.4) * CASE WHEN contains(low, 'the tion') THEN 2 ELSE 1 END) END, 6) AS score FROM c""")
def artifact_relevance(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.round(X.relevance(F.col("text"), "the tion"), 6).alias("score"))


@query()
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", X.snippet(F.col("text"), "tion the").alias("snippet"))


@query(r"""SELECT conv_id, turn FROM conversations WHERE NOT (trim(coalesce(text, '')) = '') AND length(trim(text)) >= 3 AND NOT regexp_matches(text, '(?i)^(joined|left) the (group|channel)$|^pinned a message$|changed the (group|channel) (photo|title|description)')
  AND NOT regexp_matches(text, '(?i)You received \d+ stars|^/start$|^/help$|^Gift sent$') AND NOT (role = 'system' AND length(trim(text)) < 50 AND regexp_matches(text, '^[\d\s.,+\-*/=()]+$'))""")
def message_filter(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    name = F.when(F.col("role") == "system", "systembot").otherwise("person")
    rows = load(spark, d, "conversations").where(~X.is_empty(t, F.lit(None), F.lit(None)) & ~X.is_service(F.lit(None).cast("string"), t) & (F.length(F.trim(t)) >= 3) & ~X.is_bot_spam(name, t))
    return rows.select("conv_id", "turn")


@query(f"""WITH m AS ({MESSAGES_SQL}), k AS (SELECT id, chat, ts, split_part(text, ' ', 1) AS t FROM m), n AS (SELECT *, CASE WHEN t IS NOT DISTINCT FROM lag(t) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY chat ORDER BY ts, id)),
  r AS (SELECT *, sum(new) OVER (PARTITION BY chat ORDER BY ts, id) AS run FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY chat, run ORDER BY ts, id) AS p FROM r) SELECT id, chat, t FROM p WHERE p <= 2""")
def consecutive_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).select("id", "chat", "ts", F.split_part("text", F.lit(" "), F.lit(1)).alias("t"))
    return D.consecutive(rows, "chat", "ts", F.col("t"), 1, "id").select("id", "chat", "t")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("doc_id", "text")
    return D.first_by_key(rows, F.col("text"), "doc_id").select("text", "doc_id")


@query("SELECT min(p_partkey) AS p_partkey, lower(any_value(p_name)) AS name FROM part GROUP BY lower(p_name)")
def case_insensitive_distinct(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name"))
    return D.first_by_key(rows, F.col("name"), "p_partkey")


@query("SELECT source, round(1 - count(DISTINCT lower(trim(text))) / count(*), 3) AS duplicate_rate FROM documents GROUP BY 1")
def duplicate_rate(spark: SparkSession, d: str) -> DataFrame:
    return D.duplicate_rate(load(spark, d, "documents"), F.col("text"), "source")


@query(f"SELECT id, chat FROM (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY ts DESC, id DESC) AS p FROM ({MESSAGES_SQL})) WHERE p <= 200")
def retention_newest(spark: SparkSession, d: str) -> DataFrame:
    return D.newest(messages(spark, d).select("id", "chat", "ts"), "chat", "ts", 200, "id").select("id", "chat")


@query("""SELECT o_custkey AS k, max(o_orderkey) AS v FROM orders GROUP BY 1""")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    return D.upsert(rows.where("v % 2 = 0"), rows.where("v % 2 = 1"), ["k"], "v").select("k", "v")


@query("""SELECT o_custkey AS k, coalesce(min(o_orderkey) FILTER (o_orderkey % 3 = 0), min(o_orderkey)) AS v FROM orders GROUP BY 1""")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"))
    current = D.first_by_key(rows.where("v % 3 = 0"), F.col("k"), "v")
    return current.unionByName(D.insert_absent(current, rows.where("v % 3 <> 0"), ["k"], "v")).select("k", "v")


@query("""SELECT k, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = k) THEN 'deleted' ELSE 'missing' END AS status FROM (SELECT CAST(c_custkey * 3 AS BIGINT) AS k FROM customer)""")
def batch_delete_status(spark: SparkSession, d: str) -> DataFrame:
    asked = load(spark, d, "customer").select((F.col("c_custkey") * 3).alias("k"))
    return D.delete_with_status(load(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), asked, "k")[1]


_IMP = r"""WITH b AS (SELECT doc_id, text, least((CASE WHEN regexp_matches(text, 'https?://') THEN 0.05 ELSE 0 END) + least(len(regexp_extract_all(text, '@\w+')) * 0.02, 0.1) + least(len(regexp_extract_all(text, '#\w+')) * 0.02, 0.1)
  + CASE WHEN contains(text, '?') THEN 0.03 ELSE 0 END + CASE WHEN contains(text, '```') OR len(regexp_extract_all(text, '\{')) > 3 OR len(regexp_extract_all(text, '\(')) > 5 THEN 0.05 ELSE 0 END + CASE WHEN len(regexp_extract_all(text, '\d+')) > 3 THEN 0.03 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) > 10 THEN least(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) / 100, 0.1) ELSE 0 END, 0.3) AS bonus FROM documents),
  i AS (SELECT doc_id, least(1, least((doc_id % 7) * 0.1, 0.5) + CASE WHEN doc_id % 5 = 0 THEN 0.3 ELSE 0 END + CASE WHEN length(text) > 500 THEN 0.2 WHEN length(text) > 200 THEN 0.1 ELSE 0 END + least((doc_id % 13) / 10, 1) * 0.4 + bonus)::DOUBLE AS importance FROM b)"""


def _importance(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return load(spark, d, "documents").select("doc_id", X.importance(F.col("text"), k % 7, k % 5 == 0, k % 13).alias("importance"))


@query(_IMP + " SELECT doc_id, round(importance, 6) AS importance FROM i")
def importance_score(spark: SparkSession, d: str) -> DataFrame:
    return _importance(spark, d).withColumn("importance", F.round("importance", 6))


_EVICT = _IMP + """, e AS (SELECT doc_id, round((1 - importance) * (1 / (1 + doc_id % 30)) * (1 - (doc_id % 10) / 20) + 1e-9, 6) AS score FROM i)"""


def _eviction(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    ts = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval((k % 30).cast("int"))
    score = (1 - F.col("importance")) * TM.time_decay(ts, F.lit(AS_OF)) * (1 - (k % 10) / 20)
    return _importance(spark, d).select("doc_id", F.round(score + 1e-9, 6).alias("score"))


@query(_EVICT + " SELECT doc_id, score FROM e")
def eviction_score(spark: SparkSession, d: str) -> DataFrame:
    return _eviction(spark, d)


@query(_EVICT + " SELECT doc_id, score FROM e WHERE score >= 0.2 ORDER BY score DESC, doc_id LIMIT 50")
def eviction_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _eviction(spark, d).where("score >= 0.2").orderBy(F.desc("score"), "doc_id").limit(50)


@query("SELECT event_id, round(value / (1 + epoch(TIMESTAMP '2024-01-31' - ts) / 86400), 6) AS score FROM events")
def value_eviction(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.round(F.col("value") / (1 + TM.age_days(F.col("ts"), F.lit(AS_OF))), 6).alias("score"))


@query("SELECT event_id, round(value * pow(0.5, epoch(TIMESTAMP '2024-01-31' - ts) / 86400 / 7), 6) AS weight FROM events")
def half_life_decay(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.round(TM.half_life_decay(F.col("value"), TM.age_days(F.col("ts"), F.lit(AS_OF)), 7.0), 6).alias("weight"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:00') AS hour_key, CAST(year(ts) AS VARCHAR) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week_key, CAST(isoyear(ts) AS VARCHAR) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS iso_key, strftime(ts, '%Y-%m') AS month_key FROM events")
def bucket_keys(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    return load(spark, d, "events").select("event_id", TM.bucket_key(ts, "hour").alias("hour_key"), TM.bucket_key(ts, "week").alias("week_key"), TM.iso_week_key(ts).alias("iso_key"), TM.bucket_key(ts, "month").alias("month_key"))


@query("SELECT CASE WHEN h < 6 THEN 'night' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'afternoon' ELSE 'evening' END AS part, count(*) AS n FROM (SELECT hour(ts + INTERVAL 7 HOUR) AS h FROM events) GROUP BY 1")
def time_of_day_distribution(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy(TM.time_of_day(F.col("ts"), "Asia/Bangkok").alias("part")).agg(F.count("*").alias("n"))


@query("SELECT user_id, round(avg(CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS mean_k, count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) > 50) AS high FROM events GROUP BY 1")
def json_map_read(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return load(spark, d, "events").groupBy("user_id").agg(F.round(F.avg(k), 6).alias("mean_k"), F.count_if(k > 50).alias("high"))


@query("""SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || CAST(user_id AS VARCHAR) || '}') AS key FROM events""")
def stable_cache_key(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.sha2(F.to_json(F.struct("event_type", "user_id")), 256).alias("key"))


@query("""SELECT p_partkey, list_transform(range(0, 64), lambda k: round(c[k + 1] / sqrt(list_sum(list_transform(c, lambda x: x * x))), 6)) AS v FROM (
  SELECT p_partkey, list_transform(range(0, 64), lambda k: CAST(len(list_filter(string_split(p_name, ' '), lambda w: ('0x' || right(md5(w), 15))::BIGINT % 64 = k)) AS DOUBLE)) AS c FROM part)""")
def hash_embedding(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", F.transform(X.hash_embedding(F.split("p_name", " ")), lambda x: F.round(x, 6)).alias("v"))


@query("SELECT source, lang, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY GROUPING SETS ((source), (lang), ())")
def source_and_tag_counts(spark: SparkSession, d: str) -> DataFrame:
    load(spark, d, "documents").createOrReplaceTempView("tm_documents")
    return spark.sql("SELECT source, lang, count(*) AS n, round(avg(n_chars), 6) AS mean FROM tm_documents GROUP BY GROUPING SETS ((source), (lang), ())")


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w, source FROM documents), c AS (SELECT source, w, count(*) AS n FROM t WHERE length(w) >= 4 GROUP BY 1, 2)
  SELECT source, w, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, w) AS p FROM c) WHERE p <= 3""")
def keyword_summary(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    words = load(spark, d, "documents").select("source", F.explode(X.extract_all(F.lower("text"), "[a-z]+")).alias("w")).where(F.length("w") >= 4)
    counted = words.groupBy("source", "w").agg(F.count("*").alias("n"))
    return counted.withColumn("p", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "w"))).where("p <= 3").drop("p")


@query("SELECT doc_id, CAST(floor(length(text) * 0.25) + 5 + CASE WHEN doc_id % 4 = 0 THEN 20 ELSE 0 END AS BIGINT) AS tokens FROM documents")
def estimated_tokens(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", X.estimated_tokens(F.col("text"), 0.25, F.col("doc_id") % 4 == 0).cast("long").alias("tokens"))
