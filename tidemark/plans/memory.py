"""Queries over entities, quality, portfolios and records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import market as M
from ..functions import text as X
from ..functions import time as TM
from ..operators import market as K
from ..operators import quality as Q
from ..operators import sessions as N
from ..operators import telemetry as T
from ..sources.readers import strip_html as strip
from ..sources.tables import CANDLES_SQL, MESSAGES_SQL, SIGNALS_SQL, candles, load, messages, signals
from .registry import query

_MENTIONS = "SELECT event_type AS type, CAST(json_extract(props, '$.k') AS VARCHAR) AS value, 'chat' || CAST(user_id % 10 AS VARCHAR) AS chat, ts FROM events"


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select(F.col("event_type").alias("type"), F.get_json_object("props", "$.k").alias("value"), F.concat(F.lit("chat"), (F.col("user_id") % 10).cast("string")).alias("chat"), "ts")


_COUNTS = f"e AS (SELECT type, value, count(*) AS n, count(DISTINCT chat) AS chats, min(ts) AS first, max(ts) AS last FROM ({_MENTIONS}) GROUP BY 1, 2), c AS (SELECT *, n >= CASE type WHEN 'click' THEN 20 ELSE 22 END AS learned FROM e)"


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return Q.entity_counts(_mentions(spark, d), {"click": 20}, 22)


@query(f"WITH {_COUNTS} SELECT type, value, n, chats, first, last, learned FROM c")
def entity_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return _counts(spark, d)


@query(f"WITH {_COUNTS} SELECT type, count(*) AS tracked, count(*) FILTER (learned) AS learned, count(*) FILTER (NOT learned) AS candidates FROM c GROUP BY 1")
def entity_stats(spark: SparkSession, d: str) -> DataFrame:
    return Q.entity_stats(_counts(spark, d))


@query(f"WITH {_COUNTS} SELECT type, value, round(least(1, 0.2 + 0.8 * n / max(n) OVER ()), 6) AS importance FROM c")
def entity_profile_importance(spark: SparkSession, d: str) -> DataFrame:
    return Q.entity_importance(_counts(spark, d)).select("type", "value", F.round("importance", 6).alias("importance"))


@query(f"SELECT chat, value, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY n DESC, value) AS r FROM (SELECT chat, value, count(*) AS n FROM ({_MENTIONS}) GROUP BY 1, 2)) WHERE r <= 10")
def chat_entity_stats(spark: SparkSession, d: str) -> DataFrame:
    return Q.top_per_group(_mentions(spark, d).groupBy("chat", "value").agg(F.count("*").alias("n")), "chat", 10)


@query("WITH s AS (SELECT DISTINCT l_orderkey AS s, CAST(l_partkey % 40 AS INTEGER) AS v FROM lineitem) SELECT a.v AS a, b.v AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.v < b.v GROUP BY 1, 2")
def entity_co_mentions(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("s"), (F.col("l_partkey") % 40).cast("int").alias("value"))
    return Q.co_mentions(rows, "s")


@query("SELECT tag, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest([source, lang]) AS tag FROM documents) GROUP BY 1")
def tag_statistics(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.explode(F.array("source", "lang")).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


_LENGTHS = "[n_chars % 400, n_chars % 331, n_chars % 170]"


@query(f"""WITH b AS (SELECT doc_id, doc_id % 3 = 0 AS br, (doc_id % 11) / 10 AS co, (doc_id % 7) / 6 AS cl, doc_id % 2 = 0 AS f1, doc_id % 5 < 3 AS f2, (doc_id % 4) / 8 AS du,
  list_sum(list_transform({_LENGTHS}, lambda n: CASE WHEN n > 160 THEN ceil((least(n, 220) - 160) / 30) ELSE 0 END + CASE WHEN n > 220 THEN ceil((least(n, 300) - 220) / 30) * 2 ELSE 0 END)) AS pen FROM documents)
  SELECT doc_id, round(greatest(0, least(100, (CASE WHEN br THEN least(co, 1) * 0.35 + least(cl, 1) * 0.10 + f1::INT * 0.05 + f2::INT * 0.05 + f1::INT * 0.05 + (1 - du) * 0.15 + f2::INT * 0.25
    ELSE least(co, 1) * 0.20 + least(cl, 1) * 0.10 + f1::INT * 0.30 + f2::INT * 0.15 + f1::INT * 0.10 + (1 - du) * 0.05 + f2::INT * 0.10 END) * 100 - pen)), 5) AS score, CAST(pen AS BIGINT) AS penalty FROM b""")
def session_quality_score(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("doc_id"), F.col("n_chars")
    lengths = F.array(n % 400, n % 331, n % 170)
    f1, f2 = k % 2 == 0, k % 5 < 3
    score = Q.quality_score(F.when(k % 3 == 0, "broadcast").otherwise("group"), (k % 11) / 10, (k % 7) / 6, {"actions": f1, "risks": f2, "threads": f1, "structure": f2}, (k % 4) / 8, lengths)
    return load(spark, d, "documents").select("doc_id", F.round(score, 5).alias("score"), Q.length_penalty(lengths).alias("penalty"))


@query("SELECT doc_id, round(least(100, least(30, n_chars * 0.3) + least(30, (doc_id % 5) * 10) + least(15, (doc_id % 4) * 7.5) + least(10, (doc_id % 3) * 5) + least(5, (doc_id % 3) * 2.5) + CASE WHEN lang = 'en' THEN 10 ELSE 0 END), 4)::DOUBLE AS score FROM documents")
def summary_quality_score(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    return load(spark, d, "documents").select("doc_id", F.round(Q.summary_score(F.col("n_chars"), k % 5, k % 4, k % 3, k % 3, F.col("lang") == "en"), 4).alias("score"))


@query("""
SELECT o_custkey, round(sum(o_totalprice), 2) AS invested, round(sum(o_totalprice * (o_orderkey % 21 - 10) / 100) + 1e-5, 2) AS pnl,
       round(sum(o_totalprice * (o_orderkey % 21 - 10) / 100) / sum(o_totalprice) * 100, 6) AS pnl_pct,
       arg_max(o_orderkey, (o_orderkey % 21 - 10, o_orderkey)) AS best, arg_min(o_orderkey, (o_orderkey % 21 - 10, o_orderkey)) AS worst,
       CASE WHEN count(*) > 5 THEN 'high' WHEN count(*) > 3 THEN 'medium' ELSE 'low' END AS risk
FROM orders GROUP BY 1""")
def portfolio_summary(spark: SparkSession, d: str) -> DataFrame:
    move = F.col("o_orderkey") % 21 - 10
    price = F.col("o_totalprice")
    rows = load(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("symbol"), price.alias("invested"), (price + price * move / 100).alias("value"), move.alias("move"))
    out = Q.portfolio_summary(rows, "o_custkey", pct=F.col("move"))
    return out.select("o_custkey", F.round("invested", 2).alias("invested"), F.round(F.col("pnl") + 1e-5, 2).alias("pnl"), F.round("pnl_pct", 6).alias("pnl_pct"), "best", "worst", "risk")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 41 - 20 <= -10 THEN 'close_loss' WHEN o_orderkey % 41 - 20 >= 15 THEN 'close_profit' ELSE 'hold' END AS action FROM orders")
def auto_risk_rules(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", Q.risk_rules(F.col("o_orderkey") % 41 - 20, 10, 15).alias("action"))


@query(f"""SELECT signal_id, list_filter([CASE WHEN direction = 'long' AND confidence > 70 THEN 'rsi_high' END, CASE WHEN direction <> 'long' AND confidence < 55 THEN 'rsi_low' END, CASE WHEN position_size < 15 THEN 'adx_low' END, CASE WHEN abs(leverage - 3) > 1 THEN 'drawdown' END], lambda x: x IS NOT NULL) AS broken FROM ({SIGNALS_SQL}) WHERE direction IS NOT NULL""")
def portfolio_safety_check(spark: SparkSession, d: str) -> DataFrame:
    broken = Q.safety_violations(F.col("direction") == "long", F.col("confidence"), F.col("position_size"), F.col("leverage") - 3, rsi_long=70, rsi_short=55, adx_min=15, most_drawdown=1)
    return signals(spark, d).where("direction is not null").select("signal_id", broken.alias("broken"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (CASE WHEN l_quantity > 10 THEN l_quantity END >= 20 OR l_quantity <= 10) AND abs(l_discount) <= 0.05 AND abs(l_tax) >= 0.02")
def derivatives_predicate(spark: SparkSession, d: str) -> DataFrame:
    ok = Q.derivatives_ok(F.when(F.col("l_quantity") > 10, F.col("l_quantity")), F.col("l_discount"), F.col("l_tax"), 20, 0.05, 0.02)
    return load(spark, d, "lineitem").where(ok).select("l_orderkey", "l_linenumber")


@query("""WITH h AS (SELECT *, (value < 50)::INT AS h FROM events), g AS (SELECT *, sum(1 - h) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM h), s AS (SELECT *, sum(h) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS streak FROM g)
  SELECT user_id, CAST(max(streak) AS BIGINT) AS longest, max(streak) >= 12 AS halted FROM s GROUP BY 1""")
def consecutive_loss_halt(spark: SparkSession, d: str) -> DataFrame:
    s = Q.streaks(load(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("value") < 50)
    return s.groupBy("user_id").agg(F.max("streak").cast("long").alias("longest")).select("user_id", "longest", M.should_halt(F.lit(0.0), F.col("longest"), 5.0, 12).alias("halted"))


@query(f"""WITH s AS (SELECT *, CASE WHEN direction = 'long' THEN 1.0 ELSE -1.0 END::DOUBLE AS sg, entry * 0.02 AS atr FROM ({SIGNALS_SQL}))
  SELECT signal_id, round(CASE WHEN direction = 'long' THEN greatest(entry - atr, 0) ELSE entry + atr END + 1e-7, 4) AS stop_loss, round(entry + sg * atr * 1.5 + 1e-7, 4) AS tp1, round(entry * 0.01 / atr * 8.5 + 1e-7, 4) AS size FROM s""")
def risk_assessment(spark: SparkSession, d: str) -> DataFrame:
    risk = M.risk_assessment(F.col("entry"), F.col("entry") * 0.02, F.col("direction"), 1.0, (5, 12))
    r = signals(spark, d).select("signal_id", risk.alias("r"))
    return r.select("signal_id", F.round(F.col("r.stop_loss") + 1e-7, 4).alias("stop_loss"), F.round(F.col("r.take_profit")[0] + 1e-7, 4).alias("tp1"), F.round(F.col("r.position_size") + 1e-7, 4).alias("size"))


@query("SELECT p_partkey, CAST(floor(CAST(p_retailprice AS DECIMAL(20, 8)) / 0.25) * 0.25 AS DOUBLE) AS down FROM part")
def round_to_step(spark: SparkSession, d: str) -> DataFrame:
    value = F.col("p_retailprice").cast("decimal(20,8)")
    return load(spark, d, "part").select("p_partkey", M.round_to_step(value, F.lit("0.25").cast("decimal(20,8)")).cast("double").alias("down"))


@query(f"""SELECT signal_id, round(0.5 * (signal_id % 4) + least(5, greatest(0, confidence / 10)) + coalesce(least(3, greatest(0, abs(take_profit[1] - entry) / nullif(abs(entry - stop_loss), 0))), 0) + CASE signal_id % 3 WHEN 0 THEN 0.4 WHEN 1 THEN 0.2 ELSE 0 END, 4) AS score FROM ({SIGNALS_SQL})""")
def candidate_score(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("signal_id")
    score = M.candidate_score(k % 4, F.col("confidence"), F.col("entry"), F.col("stop_loss"), F.col("take_profit")[0], F.when(k % 3 == 0, "breakout").when(k % 3 == 1, "pullback").otherwise("other"))
    return signals(spark, d).select("signal_id", F.round(score, 4).alias("score"))


@query(f"WITH s AS (SELECT chat || '-' || strftime(ts, '%Y%m%d') AS sid, chat, min(ts) AS ts FROM ({MESSAGES_SQL}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY ts, sid) AS k FROM s) SELECT a.sid, b.sid AS previous, CAST(a.k - b.k AS INTEGER) AS place FROM r a JOIN r b ON a.chat = b.chat AND b.k BETWEEN a.k - 5 AND a.k - 1")
def previous_sessions(spark: SparkSession, d: str) -> DataFrame:
    s = messages(spark, d).groupBy(F.concat_ws("-", "chat", F.date_format("ts", "yyyyMMdd")).alias("sid"), "chat").agg(F.min("ts").alias("ts"))
    return Q.previous_sessions(s, "chat", "ts", "sid")


@query("SELECT source, kind, target, count(*) AS weight FROM (SELECT source, 'lang' AS kind, lang AS target FROM documents UNION ALL SELECT source, 'size', CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END FROM documents) GROUP BY 1, 2, 3")
def insight_graph(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").withColumns({"langs": F.array("lang"), "sizes": F.array(F.when(F.col("n_chars") > 1000, "long").otherwise("short"))})
    return Q.bipartite(docs, "source", lang="langs", size="sizes")


@query("SELECT event_id AS id, value AS score FROM events ORDER BY value DESC, event_id LIMIT (SELECT count(*) - 500 FROM events)")
def prune_highest(spark: SparkSession, d: str) -> DataFrame:
    return Q.prune(load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("score")), 500)


@query("SELECT id, score FROM (SELECT event_id AS id, value AS score, row_number() OVER (ORDER BY value, event_id) AS p FROM events WHERE user_id % 5 <> 0) WHERE p <= (SELECT greatest(count(*) - 500, 0) FROM events)")
def prune_lowest_keep_frozen(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("score"), (F.col("user_id") % 5 == 0).alias("frozen"))
    return Q.prune(rows, 500, "lowest", F.col("frozen")).select("id", "score")


@query("SELECT count(*) FILTER (dayofweek(ts) NOT IN (0, 6)) AS workday, count(*) FILTER (dayofweek(ts) IN (0, 6)) AS weekend, user_id FROM events GROUP BY user_id")
def workday_weekend(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("user_id").agg(F.count_if(F.weekday("ts") < 5).alias("workday"), F.count_if(F.weekday("ts") >= 5).alias("weekend"))


@query("SELECT dayname(ts) AS day, count(*) AS n FROM events GROUP BY 1")
def day_of_week_distribution(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy(F.date_format("ts", "EEEE").alias("day")).agg(F.count("*").alias("n"))


@query(f"SELECT chat, round(count(*) / (date_sub('second', min(ts), max(ts)) / 3600), 6) AS per_hour FROM ({MESSAGES_SQL}) GROUP BY 1 HAVING max(ts) > min(ts)")
def message_frequency(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).groupBy("chat").agg(F.count("*").alias("n"), F.expr("timestampdiff(SECOND, min(ts), max(ts))").alias("s"))
    return rows.where("s > 0").select("chat", F.round(F.col("n") / (F.col("s") / 3600), 6).alias("per_hour"))


@query(f"""WITH g AS (SELECT chat, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) > 1800000000 THEN 1 ELSE 0 END AS nw, id FROM ({MESSAGES_SQL}) WINDOW w AS (PARTITION BY chat ORDER BY ts, id)), s AS (SELECT *, sum(nw) OVER (PARTITION BY chat ORDER BY ts, id) AS k FROM g),
  m AS (SELECT chat, k, count(*) AS n FROM s GROUP BY 1, 2) SELECT chat, count(*) AS sessions, round(avg(n) FILTER (n > 1), 6) AS mean_messages FROM m GROUP BY 1""")
def session_pattern_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = N.gap_sessions(messages(spark, d), "chat", "ts", 30, "id").groupBy("chat", "session_no").agg(F.count("*").alias("n"))
    return s.groupBy("chat").agg(F.count("*").alias("sessions"), F.round(F.avg(F.when(F.col("n") > 1, F.col("n"))), 6).alias("mean_messages"))


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, round(avg(length(text)), 6) AS mean_length, arg_max(role, turn) AS last_role FROM conversations GROUP BY 1")
def conversation_summary(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("role").alias("roles"), F.round(F.avg(F.length("text")), 6).alias("mean_length"), F.max_by("role", "turn").alias("last_role"))


@query("SELECT conv_id, turn, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_links(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    return load(spark, d, "conversations").select("conv_id", "turn", F.lead("turn").over(w).alias("next_turn"), F.lead("role").over(w).alias("next_role"))


@query("SELECT doc_id, count(*) AS n, max(quality) AS quality, max(toxic) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def feedback_join(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id").join(load(spark, d, "labels"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))


@query("SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS good, round(count(*) FILTER (quality = 1) / count(*) * 0.4 + 0.4, 6) AS weight FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def feedback_preference(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").select("doc_id", "source").join(load(spark, d, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good")).withColumn("weight", F.round(0.4 + 0.4 * F.col("good") / F.col("n"), 6))


@query("SELECT user_id, count(*) AS n, round(avg((value < 50)::INT), 6) AS success_rate, round(avg(value), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p <= 50 GROUP BY 1")
def interaction_learning(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.dedup import newest

    last = newest(load(spark, d, "events"), "user_id", "ts", 50, "event_id")
    return last.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") < 50).cast("int")), 6).alias("success_rate"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT event_id, event_type, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_type <> 'error' ORDER BY ts DESC, event_id LIMIT 100")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").where((F.col("ts") >= F.lit(datetime(2024, 1, 10))) & (F.col("event_type") != "error"))
    return rows.orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "event_type", "ts")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion the')")
def substring_search(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").where(F.lower("text").contains("tion the")).select("doc_id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) > 0 AS truthy FROM events")
def json_conditions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", J.truthy(F.col("props"), "$.k").alias("truthy"))


@query("SELECT event_id, props AS parsed FROM events")
def fenced_json(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", J.fenced(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).alias("parsed"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS text, epoch_us(date_trunc('second', ts)) AS micros FROM events")
def parse_iso_utc(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return load(spark, d, "events").select("event_id", text.alias("text"), F.unix_micros(TM.parse_utc(text)).alias("micros"))


@query("SELECT event_id, strftime(ts + INTERVAL 3 HOUR, '%d.%m.%Y %H:%M') AS shown FROM events")
def display_time(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", TM.display(F.col("ts"), "short", "Europe/Moscow").alias("shown"))


@query("SELECT event_id, hour(ts + INTERVAL 3 HOUR) < 9 AS night FROM events")
def night_window(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", TM.in_night(F.col("ts")).alias("night"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g'))) AS digest FROM pages""")
def strip_html(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pages").select("page_id", F.md5(strip(F.col("html")).cast("binary")).alias("digest"))


@query("SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS BIGINT) AS n FROM documents")
def distinct_words(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.size(X.word_set(F.col("text"))).cast("long").alias("n"))


@query("SELECT event_type AS topic, count(*) AS processed, round(avg(value) FILTER (p <= 100), 6) AS mean_last FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS p FROM events) GROUP BY 1")
def event_bus_metrics(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    p = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return load(spark, d, "events").withColumn("p", p).groupBy(F.col("event_type").alias("topic")).agg(F.count("*").alias("processed"), F.round(F.avg(F.when(F.col("p") <= 100, F.col("value"))), 6).alias("mean_last"))


@query("SELECT event_id FROM events WHERE event_type = 'click' AND CASE WHEN value > 150 THEN 'failed' WHEN ts < TIMESTAMP '2024-01-20' THEN 'stale' ELSE 'running' END <> 'running'")
def stale_job_closing(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("value") > 150, "failed").when(F.col("ts") < F.lit(datetime(2024, 1, 20)), "stale").otherwise("running")
    return load(spark, d, "events").where((F.col("event_type") == "click") & (status != "running")).select("event_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 2 DAY AND ts <= TIMESTAMP '2024-01-20'")
def window_duration(spark: SparkSession, d: str) -> DataFrame:
    return T.last_days(load(spark, d, "events"), datetime(2024, 1, 20), "2d").select("event_id")


@query(f"""
WITH c AS ({CANDLES_SQL}),
  day AS (SELECT symbol, arg_max(high, ts) AS day_high, arg_max(low, ts) AS day_low, arg_max(volume, ts) AS day_volume, arg_max((close - open) / open * 100, ts) AS day_change FROM c GROUP BY symbol)
SELECT o_orderkey, o_orderpriority AS symbol, o_totalprice / 1000 + 1000 AS price, round(day_high, 6) AS day_high, round(day_low, 6) AS day_low, day_volume, round(day_change, 6) AS day_change
FROM orders LEFT JOIN day ON symbol = o_orderpriority""")
def tickers_with_stats(spark: SparkSession, d: str) -> DataFrame:
    """Prices of orders as tickers of their priority, with its last day's statistics."""
    tickers = load(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("symbol"), (F.col("o_totalprice") / 1000 + 1000).alias("price"))
    out = K.tickers_with_stats(tickers, K.day_stats(candles(spark, d)))
    return out.select("o_orderkey", "symbol", "price", *(F.round(c, 6).alias(c) for c in ("day_high", "day_low")), "day_volume", F.round("day_change", 6).alias("day_change"))
