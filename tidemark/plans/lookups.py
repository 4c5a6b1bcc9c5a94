"""Queries of names, words, amounts, files, profiles and clusters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import time as TM
from ..operators import learning as L
from ..operators import quality as Q
from ..operators import screeners as C
from ..shared import new_path
from ..sources import readers as R
from ..sources import sinks as W
from ..sources.tables import CANDLES_SQL, candles, load
from .registry import query

_WORDS = "list_filter(string_split_regex(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z]+'), lambda x: x <> '')"


def _words(column: str):  # noqa: ANN202
    low = F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, "[^a-z]+"), lambda x: x != "")


@query(f"""
WITH g AS (
  SELECT DISTINCT w[1] || ' ' || w[2] AS name, CASE item_id % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'organisation' ELSE 'place' END AS kind
  FROM (SELECT item_id, {_WORDS.format(c="text")} AS w FROM benchmark) WHERE len(w) >= 2),
  d AS (SELECT doc_id, {_WORDS.format(c="text")} AS w FROM documents),
  r AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS name FROM d WHERE len(w) >= 2)
SELECT doc_id, kind, name, count(*) AS n FROM r JOIN g USING (name) GROUP BY ALL""")
def named_entities(spark: SparkSession, d: str) -> DataFrame:
    """Names of a gazetteer (the first two words of each passage) in whole documents."""
    w = load(spark, d, "benchmark").select("item_id", _words("text").alias("w")).where(F.size("w") >= 2)
    kind = F.when(F.col("item_id") % 3 == 0, "person").when(F.col("item_id") % 3 == 1, "organisation").otherwise("place")
    names = w.select(F.concat_ws(" ", F.col("w")[0], F.col("w")[1]).alias("name"), kind.alias("kind"))
    return X.named_entities(load(spark, d, "documents").select("doc_id", _words("text").alias("tokens")), names, "doc_id", "tokens")


@query("""
WITH f AS (SELECT DISTINCT source, 'group' || CAST(CAST(substr(source, 4) AS INTEGER) % 5 AS VARCHAR) AS form FROM documents WHERE source IS NOT NULL)
SELECT doc_id, list_sort(list_distinct(list_filter([lang, d.source, form], lambda x: x IS NOT NULL))) AS variants FROM documents d LEFT JOIN f ON f.source = d.source""")
def word_variants(spark: SparkSession, d: str) -> DataFrame:
    """The words of a row and their forms, from a dictionary that is a table."""
    docs = load(spark, d, "documents").select("doc_id", "lang", "source")
    form = F.concat(F.lit("group"), (F.substring("source", 4, 9).cast("int") % 5).cast("string"))
    forms = docs.where("source is not null").select(F.col("source").alias("word"), form.alias("form"))
    return X.with_variants(docs.withColumn("tokens", F.array_compact(F.array("lang", "source"))), forms, "tokens").select("doc_id", "variants")


@query("""
SELECT o_orderkey, 'cost MONEY_USD AMOUNT_' || CAST(1 + o_orderkey % 9 AS VARCHAR) || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') || '.50 then MILLION VALUE_' || CAST(o_custkey % 77 AS VARCHAR)
       || ' and PERCENTAGE VALUE_' || CAST(o_orderkey % 50 AS VARCHAR) || ', MONEY_EUR AMOUNT_' || CAST(o_orderkey % 400 AS VARCHAR) AS text FROM orders""")
def rewritten_numbers(spark: SparkSession, d: str) -> DataFrame:
    text = F.format_string("cost $%d,%03d.50 then %d млн and %d%%, %d евро", 1 + F.col("o_orderkey") % 9, F.col("o_custkey") % 1000, F.col("o_custkey") % 77, F.col("o_orderkey") % 50, F.col("o_orderkey") % 400)
    return load(spark, d, "orders").select("o_orderkey", X.rewrite_numbers(text).alias("text"))


@query("""
SELECT doc_id, list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789%$€₽', 'abcdefghijklmnopqrstuvwxyz'), '[а-яё]+|[a-z]+'),
       lambda x: length(x) >= 3 AND x NOT IN ('the', 'and', 'that', 'что', 'это', 'как')) AS words FROM documents""")
def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of three letters or more without stop words; the given texts have no Cyrillic, and digits are taken out before."""
    plain = F.translate(F.translate("text", "0123456789%$€₽", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return load(spark, d, "documents").select("doc_id", X.word_tokens(plain).alias("words"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS ts FROM orders")
def flexible_times(spark: SparkSession, d: str) -> DataFrame:
    """Dates in four spellings, and text that is none."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 5
    text = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "dd.MM.yyyy")).when(k == 2, F.date_format(day, "dd/MM/yyyy")).when(k == 3, F.date_format(day, "yyyy-MM-dd'T'00:00:00'Z'")).otherwise("some day")
    return load(spark, d, "orders").select("o_orderkey", TM.parse_flexible(text).cast("timestamp_ntz").alias("ts"))


def _by_nation(spark: SparkSession, d: str) -> str:
    """Names of customers as text files, a folder for each nation."""
    path = new_path(spark, "texts")
    rows = load(spark, d, "customer").select(F.col("c_name").alias("value"), F.col("c_nationkey").alias("nation"))
    rows.repartition("nation").write.partitionBy("nation").text(path)
    return path


@query("SELECT DISTINCT c_nationkey AS nation FROM customer")
def new_files_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that changed since a time, by their names alone."""
    found = R.new_files(spark, f"{_by_nation(spark, d)}/*/*.txt", datetime(2000, 1, 1))
    return found.select(F.regexp_extract("path", r"nation=(\d+)", 1).cast("int").alias("nation")).distinct()


@query("SELECT c_nationkey AS nation, 'names' AS kind, CAST(sum(length(c_name)) AS BIGINT) AS size FROM customer GROUP BY 1")
def artifact_files(spark: SparkSession, d: str) -> DataFrame:
    """Whole text files by kind."""
    found = R.artifacts(spark, {"names": f"{_by_nation(spark, d)}/*/*.txt"})
    return found.groupBy(F.regexp_extract("path", r"nation=(\d+)", 1).cast("int").alias("nation"), "kind").agg(F.sum(F.length(F.regexp_replace("content", "\\n", ""))).alias("size"))


@query(f"SELECT symbol, month, arg_max(ts, ts) AS ts, round(arg_max(close, ts), 5) AS close FROM (SELECT *, strftime(ts, '%Y-%m') AS month FROM ({CANDLES_SQL})) GROUP BY 1, 2")
def last_candles(spark: SparkSession, d: str) -> DataFrame:
    """The last candle of each month's array."""
    rows = candles(spark, d).groupBy("symbol", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("candles"))
    return R.last_candle(rows).select("symbol", "month", "candle.ts", F.round("candle.close", 5).alias("close"))


@query(f"SELECT symbol, count(*) AS n FROM ({CANDLES_SQL}) GROUP BY 1")
def source_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The first source has nothing; the second is taken."""
    every = candles(spark, d)
    return C.first_available(every.where("symbol = 'elsewhere'"), every).groupBy("symbol").agg(F.count("*").alias("n"))


_VERSIONS = "v AS (SELECT 'p' || CAST(o_custkey AS VARCHAR) AS profile_id, o_orderkey AS version_id, o_orderstatus <> 'F' AS active, o_totalprice AS score FROM orders)"


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("profile_id"), F.col("o_orderkey").alias("version_id"), (F.col("o_orderstatus") != "F").alias("active"), F.col("o_totalprice").alias("score"))


@query(f"WITH {_VERSIONS} SELECT profile_id, max(version_id) AS version_id, profile_id = (SELECT max(profile_id) FROM v) AS active FROM v GROUP BY 1")
def profile_activation(spark: SparkSession, d: str) -> DataFrame:
    """One profile is active, the last by name."""
    v = _versions(spark, d)
    return L.activate(L.current_profiles(v), v.agg(F.max("profile_id")).first()[0]).select("profile_id", "version_id", "active")


@query(f"WITH {_VERSIONS}, p AS (SELECT max(profile_id) AS p FROM v), o AS (SELECT v.* FROM v, p WHERE profile_id = p.p) SELECT profile_id, (SELECT max(version_id) + 1 FROM o) AS version_id, active, score FROM o WHERE version_id = (SELECT min(version_id) FROM o)")
def profile_rollback(spark: SparkSession, d: str) -> DataFrame:
    """The first version's content as the newest version of the last profile by name."""
    v = _versions(spark, d)
    name = v.agg(F.max("profile_id")).first()[0]
    first = v.where(F.col("profile_id") == name).agg(F.min("version_id")).first()[0]
    return L.rollback(v, name, first).select("profile_id", "version_id", "active", "score")


@query(f"""
WITH {_VERSIONS}, c AS (SELECT profile_id, arg_min(score, version_id) AS a, arg_max(score, version_id) AS b FROM v GROUP BY 1)
SELECT profile_id, CASE WHEN b - a > 0.01 THEN 'candidate' ELSE 'current' END AS better FROM c""")
def profile_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The newest version's score against the first one's."""
    c = _versions(spark, d).groupBy("profile_id").agg(F.min_by("score", "version_id").alias("a"), F.max_by("score", "version_id").alias("b"))
    return c.select("profile_id", L.compare_profiles(F.col("b"), F.col("a")).alias("better"))


@query("""
SELECT doc_id, round(least(1, CASE doc_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.3 WHEN 2 THEN 0.6 ELSE 0.5 END + CASE WHEN doc_id % 2 = 0 THEN 0.05 ELSE 0 END), 4)::DOUBLE AS quality FROM documents""")
def source_quality(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    source = F.when(k % 5 == 0, "News").when(k % 5 == 1, "user").when(k % 5 == 2, "Telegram").when(k % 5 == 3, "blog")
    return load(spark, d, "documents").select("doc_id", F.round(Q.source_quality(source, F.when(k % 2 == 0, "chat")), 4).alias("quality"))


@query("""
WITH e AS (SELECT o_orderpriority AS target, sum(1) AS n, max(o_totalprice) AS w FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT arg_min(target, (-n, target)) AS dominant, CAST(max(n) AS BIGINT) AS n, max(w) AS heaviest FROM e""")
def dominant_tag(spark: SparkSession, d: str) -> DataFrame:
    """The priority of most open orders; the dearest order is the heaviest edge."""
    o = load(spark, d, "orders")
    ones = o.select(F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("target"), F.col("o_orderkey").alias("source"), F.lit(1).alias("weight"))
    found = Q.dominant(ones, "O").select("dominant", F.col("n").cast("long").alias("n"))
    dear = o.select(F.col("o_orderstatus").alias("kind"), F.lit("all").alias("target"), F.col("o_orderkey").alias("source"), F.col("o_totalprice").alias("weight"))
    return found.crossJoin(Q.dominant(dear, "O").select("heaviest"))


@query("""
WITH s AS (SELECT o_custkey AS cluster, o_orderstatus AS chat, o_orderdate AS t, o_orderkey AS n, o_orderpriority AS topic FROM orders),
  c AS (SELECT cluster, chat, count(*) AS k FROM s GROUP BY 1, 2), b AS (SELECT cluster, arg_min(chat, (-k, chat)) AS chat FROM c GROUP BY 1),
  t AS (SELECT cluster, topic, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, topic) AS p FROM s GROUP BY 1, 2),
  l AS (SELECT cluster, list(topic ORDER BY p) AS topics FROM t WHERE p <= 2 GROUP BY 1)
SELECT s.cluster, b.chat, CAST(sum(n) AS BIGINT) AS messages, l.topics, date_diff('day', CAST(min(t) AS DATE), CAST(max(t) AS DATE))::DOUBLE AS days
FROM s JOIN b USING (cluster) JOIN l USING (cluster) GROUP BY ALL""")
def cluster_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Customers as clusters of orders: their most frequent status and priorities, how many days they span."""
    day = F.col("o_orderdate").cast("timestamp")
    rows = load(spark, d, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderstatus").alias("chat"), day.alias("start"), day.alias("end"), F.col("o_orderkey").alias("n"), F.array("o_orderpriority").alias("topics"))
    return Q.cluster_metadata(rows, "cluster", 2).select("cluster", "chat", "messages", "topics", "days")


@query("""
WITH h AS (SELECT event_id, md5(event_type) AS a, md5('u' || CAST(user_id AS VARCHAR)) AS b FROM events),
  digits AS (SELECT event_id, a, b, list_sum(list_transform(string_split(a, ''), lambda c: instr('0123456789abcdef', c) - 1)) % 3 AS a3, list_sum(list_transform(string_split(b, ''), lambda c: instr('0123456789abcdef', c) - 1)) % 3 AS b3,
                    CAST('0x' || right(a, 2) AS INTEGER) % 128 AS a7, CAST('0x' || right(b, 2) AS INTEGER) % 128 AS b7 FROM h)
SELECT event_id, list_sort(list_distinct([CAST((a7 * 129 + a3 * 256) % 384 AS INTEGER), CAST((b7 * 129 + b3 * 256) % 384 AS INTEGER)])) AS places FROM digits""")
def hash_embedding_384(spark: SparkSession, d: str) -> DataFrame:
    """Where the vectors of two words aren't 0."""
    v = load(spark, d, "events").select("event_id", X.hash_embedding(F.array("event_type", F.concat(F.lit("u"), F.col("user_id").cast("string"))), 384).alias("v"))
    return v.select("event_id", F.filter(F.transform("v", lambda x, k: F.when(x > 0, k)), lambda k: k.isNotNull()).alias("places"))


@query("""
SELECT 'node' AS part, 'supplier' || CAST(s_suppkey AS VARCHAR) AS id FROM supplier UNION ALL SELECT 'node', 'nation' || CAST(n_nationkey AS VARCHAR) FROM nation
UNION ALL SELECT 'edge', 'supplier' || CAST(s_suppkey AS VARCHAR) || '>' || 'nation' || CAST(s_nationkey AS VARCHAR) FROM supplier""")
def graphml_parts(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers and nations as GraphML in parts, written by tasks and read again line by line."""
    s, n = load(spark, d, "supplier"), load(spark, d, "nation")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    nodes = s.select(name("supplier", "s_suppkey").alias("id")).union(n.select(name("nation", "n_nationkey")))
    edges = s.select(name("supplier", "s_suppkey").alias("source_id"), name("nation", "s_nationkey").alias("target_id"), F.col("s_acctbal").alias("weight"))
    path = new_path(spark, "graphml")
    W.graphml_parts(nodes, edges, path)
    lines = spark.read.text(f"{path}/*")
    get = lambda pattern: F.regexp_extract("value", pattern, 1)
    found = lines.where("value like '<node%' or value like '<edge%'").select(F.substring("value", 2, 4).alias("part"), F.when(F.col("value").startswith("<node"), get('id="([^"]*)"')).otherwise(F.concat_ws(">", get('source="([^"]*)"'), get('target="([^"]*)"'))).alias("id"))
    return found
