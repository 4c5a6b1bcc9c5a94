"""Tables of a folder of Parquet files, and the views of them that operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configured


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table by its name. Columns and filters that a query needs reach the scan."""
    return configured(spark).read.parquet(f"{folder}/{name}.parquet")


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as facts: (id, ts, kind, actor, correlation_id, value, payload: JSON text).

    Kinds: view is a plan, click an execution, error an error, purchase an outcome, signup a trade. A correlation id is the user's
    day. An execution or outcome succeeds if its value is below 50.
    """
    events = load(spark, folder, "events")
    kinds = {"view": "Fact:Plan", "click": "Fact:Execution", "error": "Fact:Error", "purchase": "Fact:Outcome", "signup": "Fact:Trade"}
    kind = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()))
    return events.select(
        F.col("event_id").alias("id"),
        "ts",
        kind.alias("kind"),
        F.col("user_id").alias("actor"),
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("correlation_id"),
        "value",
        F.col("props").alias("payload"),
        (F.col("value") < 50).alias("success"),
    )


#: The same view in SQL.
FACTS_SQL = """
SELECT event_id AS id, ts,
       CASE event_type WHEN 'view' THEN 'Fact:Plan' WHEN 'click' THEN 'Fact:Execution' WHEN 'error' THEN 'Fact:Error'
                       WHEN 'purchase' THEN 'Fact:Outcome' WHEN 'signup' THEN 'Fact:Trade' END AS kind,
       user_id AS actor, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS correlation_id,
       value, props AS payload, value < 50 AS success
FROM events"""


def candles(spark: SparkSession, folder: str) -> DataFrame:
    """`orders` as daily candles of a symbol, its priority: (symbol, ts, open, high, low, close, volume).

    A price is an order's total by 1000, plus 1000. Within a day orders are in key order: the first price opens, the last closes. Volume is the number of orders.
    """
    orders = load(spark, folder, "orders").where("o_orderpriority is not null and o_orderdate is not null")
    price = F.col("o_totalprice") / 1000 + 1000
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts")).agg(
        F.min_by(price, "o_orderkey").alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, "o_orderkey").alias("close"),
        F.count("*").cast("double").alias("volume"),
    )


CANDLES_SQL = """
SELECT o_orderpriority AS symbol, o_orderdate AS ts, arg_min(o_totalprice / 1000 + 1000, o_orderkey) AS open, max(o_totalprice / 1000 + 1000) AS high,
       min(o_totalprice / 1000 + 1000) AS low, arg_max(o_totalprice / 1000 + 1000, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY 1, 2"""


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """`events` as chat messages: (id, chat, author, ts, text). A chat has the users whose ids agree modulo 10."""
    events = load(spark, folder, "events")
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("chat"), (F.col("user_id") % 10).cast("string")).alias("chat"),
        F.col("user_id").alias("author"),
        "ts",
        F.concat_ws(" ", "event_type", "props").alias("text"),
    )


MESSAGES_SQL = """
SELECT event_id AS id, 'chat' || CAST(user_id % 10 AS VARCHAR) AS chat, user_id AS author, ts, event_type || ' ' || props AS text
FROM events"""


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """`lineitem` as trading signals: (signal_id, symbol, direction, entry, confidence, leverage, position_size, stop_loss, take_profit, ts).

    Signals of return flag N have no direction.
    """
    rows = load(spark, folder, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    sign = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("signal_id"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 25).cast("string")).alias("symbol"),
        F.when(F.col("l_returnflag") == "A", "long").when(F.col("l_returnflag") == "R", "short").alias("direction"),
        price.alias("entry"),
        (F.lit(40) + F.col("l_quantity")).cast("double").alias("confidence"),
        (F.lit(1.0) + F.col("l_linenumber") % 5).alias("leverage"),
        F.col("l_quantity").alias("position_size"),
        (price * (1 - sign * F.col("l_discount"))).alias("stop_loss"),
        F.array(price * (1 + sign * 0.02), price * (1 + sign * 0.04)).alias("take_profit"),
        F.col("l_shipdate").alias("ts"),
    )


SIGNALS_SQL = """
SELECT l_orderkey * 10 + l_linenumber AS signal_id, 'S' || CAST(l_suppkey % 25 AS VARCHAR) AS symbol,
       CASE l_returnflag WHEN 'A' THEN 'long' WHEN 'R' THEN 'short' END AS direction,
       l_extendedprice / l_quantity AS entry, CAST(40 + l_quantity AS DOUBLE) AS confidence,
       1.0::DOUBLE + l_linenumber % 5 AS leverage, l_quantity AS position_size,
       (l_extendedprice / l_quantity) * (1 - (CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END)::DOUBLE * l_discount) AS stop_loss,
       [(l_extendedprice / l_quantity) * (1 + (CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END)::DOUBLE * 0.02),
        (l_extendedprice / l_quantity) * (1 + (CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE 1.0 END)::DOUBLE * 0.04)] AS take_profit,
       l_shipdate AS ts
FROM lineitem"""
