"""Queries over facts and metrics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import telemetry as T
from ..sources.tables import FACTS_SQL, facts, load
from .registry import query

AS_OF = datetime(2024, 1, 20)
_METRICS = "SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'rpc_latency' WHEN 'click' THEN 'rpc_calls' WHEN 'error' THEN 'rpc_error' ELSE 'cpu' END AS name, value, user_id FROM events"


def metrics(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("event_type") == "view", "rpc_latency").when(F.col("event_type") == "click", "rpc_calls").when(F.col("event_type") == "error", "rpc_error").otherwise("cpu")
    return load(spark, d, "events").select("event_id", "ts", name.alias("name"), "value", "user_id")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01' GROUP BY 1, 2""")
def agg_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit(datetime(2001, 6, 1)))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"),
    )


@query(f"SELECT id, ts, actor, value FROM ({FACTS_SQL}) WHERE kind = 'Fact:Error' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def filter_facts(spark: SparkSession, d: str) -> DataFrame:
    return T.filter_facts(facts(spark, d), kind="Fact:Error", start=datetime(2024, 1, 5), end=datetime(2024, 1, 12)).select("id", "ts", "actor", "value")


@query(f"SELECT event_id, ts, value FROM ({_METRICS}) WHERE name = 'rpc_latency' AND ts >= TIMESTAMP '2024-01-10' AND user_id % 2 = 1")
def filter_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics(spark, d).withColumn("tags", F.create_map(F.lit("side"), F.when(F.col("user_id") % 2 == 1, "odd").otherwise("even")))
    return T.filter_metrics(rows, name="rpc_latency", start=datetime(2024, 1, 10), tags={"side": "odd"}).select("event_id", "ts", "value")


@query(f"""SELECT count(*) FILTER (kind = 'Fact:Trade') AS total_trades, count(*) FILTER (kind = 'Fact:Outcome') AS total_outcomes,
  round(count(*) FILTER (kind = 'Fact:Outcome' AND success) / greatest(count(*) FILTER (kind = 'Fact:Outcome'), 1), 6) AS success_rate
  FROM ({FACTS_SQL}) WHERE ts BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-01-20'""")
def windowed_business_aggregates(spark: SparkSession, d: str) -> DataFrame:
    return T.business_aggregates(T.last_days(facts(spark, d), AS_OF, "7d")).withColumn("success_rate", F.round("success_rate", 6))


@query(f"""SELECT user_id, count(*) AS total_rpc_calls, round(coalesce(avg(value) FILTER (name LIKE '%latency%'), 0), 6) AS avg_latency,
  round(count(*) FILTER (name LIKE '%error%') / count(*), 6) AS error_rate FROM ({_METRICS}) WHERE name LIKE 'rpc\\_%' ESCAPE '\\' GROUP BY 1""")
def technical_aggregates(spark: SparkSession, d: str) -> DataFrame:
    out = T.technical_aggregates(metrics(spark, d), "user_id")
    return out.withColumns({c: F.round(c, 6) for c in ("avg_latency", "error_rate")})


@query("SELECT event_id, user_id, ts FROM events WHERE (user_id, ts) IN (SELECT (user_id, max(ts)) FROM events GROUP BY user_id)")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return T.latest_per_key(load(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts")


_HEALTH = "SELECT user_id, CASE WHEN event_type = 'error' THEN 'unhealthy' ELSE 'healthy' END AS status, ts AS last_check FROM events WHERE (user_id, ts) IN (SELECT (user_id, max(ts)) FROM events GROUP BY user_id)"


@query(f"""SELECT CASE WHEN count(*) = 0 THEN 'unknown' WHEN count(*) FILTER (status <> 'healthy') = 0 THEN 'healthy'
  WHEN count(*) FILTER (status = 'healthy') > 0 THEN 'degraded' ELSE 'unhealthy' END AS status, count(*) AS total,
  count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status <> 'healthy') AS unhealthy, max(last_check) AS last_check FROM ({_HEALTH})""")
def overall_health(spark: SparkSession, d: str) -> DataFrame:
    latest = T.latest_per_key(load(spark, d, "events"), "user_id", "ts")
    return T.overall_health(latest.select(F.when(F.col("event_type") == "error", "unhealthy").otherwise("healthy").alias("status"), F.col("ts").alias("last_check")))


@query("""SELECT event_type, count(*) AS n, round(avg(value * 1000), 4) AS avg_ms, round(median(value * 1000), 4) AS median_ms,
  round(list_sort(list(value))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] * 1000, 4) AS p95_ms, round(min(value * 1000), 4) AS min_ms,
  round(max(value * 1000), 4) AS max_ms, round(sum(value * 1000), 2) AS total_ms FROM events GROUP BY 1""")
def timing_summary(spark: SparkSession, d: str) -> DataFrame:
    out = T.timing_summary(load(spark, d, "events"), "event_type", seconds="value")
    return out.withColumns({c: F.round(c, 2 if c == "total_ms" else 4) for c in out.columns if c.endswith("_ms")})


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").groupBy(F.window("ts", "24 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query("""SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, count(*) AS n, round(avg(value), 6) AS mean
  FROM (SELECT value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY 1""")
def sliding_window(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("window_start"), "n", "mean")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
  SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def session_window(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return rows.select("user_id", "start", "last", "n")


@query("SELECT event_type, CAST(user_id % 10 AS BIGINT) AS shard, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ROLLUP (event_type, user_id % 10)")
def rollup_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").withColumn("shard", F.col("user_id") % 10)
    return rows.rollup("event_type", "shard").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT event_type, CAST(user_id % 10 AS BIGINT) AS shard, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 10)")
def cube_quality(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").withColumn("shard", F.col("user_id") % 10).cube("event_type", "shard").agg(F.count("*").alias("n"))


_RULES = [("slow", "rpc_latency > 150", "warning", 720, True), ("errors", "rpc_error >= 180.5", "critical", 1440, True), ("off", "cpu > 1", "info", 1, False)]


@query(f"""WITH RECURSIVE r(rule, name, op, threshold, severity, cd) AS (VALUES ('slow', 'rpc_latency', '>', 150.0, 'warning', 720), ('errors', 'rpc_error', '>=', 180.5, 'critical', 1440)),
  hits AS (SELECT DISTINCT rule, severity, cd, ts FROM ({_METRICS}) m JOIN r USING (name) WHERE CASE op WHEN '>' THEN value > threshold ELSE value >= threshold END),
  fired AS (SELECT rule, severity, cd, min(ts) AS ts FROM hits GROUP BY ALL
    UNION ALL SELECT f.rule, f.severity, f.cd, (SELECT min(h.ts) FROM hits h WHERE h.rule = f.rule AND date_diff('second', f.ts, h.ts) >= f.cd * 60) FROM fired f WHERE f.ts IS NOT NULL)
  SELECT rule, severity, ts FROM fired WHERE ts IS NOT NULL""")
def alert_rules_with_cooldown(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(_RULES, "rule string, condition string, severity string, cooldown_minutes int, enabled boolean")
    return T.fire_alerts(metrics(spark, d), rules)


@query("SELECT event_id, CASE WHEN value >= 200 THEN 'critical' WHEN value >= 150 THEN 'error' WHEN value >= 100 THEN 'warning' END AS level FROM events WHERE value >= 100")
def metric_alert_level(spark: SparkSession, d: str) -> DataFrame:
    level = T.alert_level(F.col("value"), F.lit(100), F.lit(150), F.lit(200))
    return load(spark, d, "events").select("event_id", level.alias("level")).where("level is not null")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 10 DAY")
def retention_purge(spark: SparkSession, d: str) -> DataFrame:
    return T.purge(load(spark, d, "events").select("event_id", "ts"), AS_OF, 10)


@query("""SELECT tier, count(*) AS n FROM (SELECT CASE WHEN a >= 0 AND a < 1 THEN 'now' WHEN a >= 1 AND a < 7 THEN 'fresh' WHEN a >= 7 AND a < 14 THEN 'recent' WHEN a >= 14 THEN 'old' END AS tier
  FROM (SELECT floor(epoch(TIMESTAMP '2024-01-20' - ts) / 86400) AS a FROM events WHERE ts <= TIMESTAMP '2024-01-20')) GROUP BY 1""")
def age_tiers(spark: SparkSession, d: str) -> DataFrame:
    tier = T.age_tier(F.col("ts"), F.lit(AS_OF), [("now", 0, 1), ("fresh", 1, 7), ("recent", 7, 14), ("old", 14, None)])
    return load(spark, d, "events").where(F.col("ts") <= F.lit(AS_OF)).groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, round(avg(CASE WHEN value > 0 THEN value END), 6) AS mean, round(median(CASE WHEN value > 0 THEN value END), 6) AS mid, min(CASE WHEN value > 0 THEN value END) AS low,
  max(CASE WHEN value > 0 THEN value END) AS high, round(stddev_samp(CASE WHEN value > 0 THEN value END), 6) AS spread, round(count(*) FILTER (value >= 5) / count(*), 6) AS success_rate FROM events GROUP BY 1""")
def search_quality_by_type(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.col("value") > 0, F.col("value"))
    return load(spark, d, "events").groupBy("event_type").agg(
        F.round(F.avg(v), 6).alias("mean"), F.round(F.median(v), 6).alias("mid"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.stddev_samp(v), 6).alias("spread"),
        F.round(F.count_if(F.col("value") >= 5) / F.count("*"), 6).alias("success_rate"),
    )


@query("SELECT CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def hourly_quality(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH c AS (SELECT round(avg(value) FILTER (ts >= TIMESTAMP '2024-01-15' AND value > 0), 6) AS now, round(avg(value) FILTER (ts < TIMESTAMP '2024-01-15'), 6) AS before FROM events)
  SELECT now, before, round(now - before, 6) AS change, CASE WHEN now - before > 0.5 THEN 'improving' WHEN now - before < -0.5 THEN 'declining' ELSE 'stable' END AS trend FROM c""")
def current_vs_history(spark: SparkSession, d: str) -> DataFrame:
    late = F.col("ts") >= F.lit(datetime(2024, 1, 15))
    c = load(spark, d, "events").agg(F.round(F.avg(F.when(late & (F.col("value") > 0), F.col("value"))), 6).alias("now"), F.round(F.avg(F.when(~late, F.col("value"))), 6).alias("before"))
    change = F.col("now") - F.col("before")
    return c.select("now", "before", F.round(change, 6).alias("change"), F.when(change > 0.5, "improving").when(change < -0.5, "declining").otherwise("stable").alias("trend"))
