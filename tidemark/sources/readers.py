"""Readers of files and streams. Schemas are declared, never inferred; broken records are kept apart, not fatal."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = (
    "id string, date_utc string, date string, `from` struct<id: string, username: string, display: string>, text string, reply_to string, "
    "reactions array<struct<emoji: string, count: int>>, attachments array<struct<type: string, uri: string, text: string, metadata: map<string, string>>>, "
    "language string, chat struct<id: string, title: string>, edited_utc string, action string, _corrupt_record string"
)
RECORD = "record_id string, source string, content string, timestamp string, author string, tags string"
KLINE = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_base", "taker_quote", "ignored")


def chat_dump(spark: SparkSession, folder: str, multi_line: bool = False) -> DataFrame:
    """Messages of *.json files in a chat's folder, one a line or, with `multi_line`, an array a file; records that can't be read are left out.

    Adds ts: date_utc, else date; and the file. There is no global sort: what needs an order states it.
    """
    rows = spark.read.schema(MESSAGE).option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{folder}/*.json")
    rows = rows.withColumn("file", F.col("_metadata.file_path")).where("_corrupt_record is null")
    return rows.withColumn("ts", F.coalesce(F.try_to_timestamp("date_utc"), F.try_to_timestamp("date"))).drop("_corrupt_record")


def records(messages: DataFrame, source: str) -> DataFrame:
    """Messages as records (record_id, source, content, ts, author, tags, attachments); blank texts are left out."""
    chat = F.coalesce("chat.title", F.lit("unknown"))
    key = F.concat_ws(":", F.lit(source), chat, F.coalesce("id", F.concat_ws("-", "`from`.id", F.monotonically_increasing_id().cast("string"))))
    return messages.where(F.trim(F.coalesce("text", F.lit(""))) != "").select(key.alias("record_id"), F.lit(source).alias("source"), F.col("text").alias("content"), "ts", F.col("`from`.username").alias("author"), F.array(chat).alias("tags"), "attachments")


def attachments(records_: DataFrame) -> DataFrame:
    """A row for each attachment of a record; records without keep one row of nulls."""
    return records_.select("record_id", F.explode_outer("attachments").alias("a")).select("record_id", "a.type", "a.uri", "a.text")


def window(df: DataFrame, ts: str = "ts", since: datetime | None = None, before: datetime | None = None, as_of: datetime | None = None) -> DataFrame:
    """Rows since a time (it belongs to them) or before one (not); before a time there is at most the year up to `as_of`."""
    if since is not None:
        df = df.where(F.col(ts) >= F.lit(since))
    if before is not None:
        df = df.where(F.col(ts) < F.lit(before))
        if as_of is not None:
            df = df.where(F.col(ts) >= F.lit(as_of) - F.expr("INTERVAL 1 YEAR"))
    return df


def last_n(df: DataFrame, n: int, ts: str = "ts", *ties: str) -> DataFrame:
    return df.orderBy(F.desc(ts), *map(F.desc, ties)).limit(n)


def new_files(spark: SparkSession, pattern: str, since: datetime) -> DataFrame:
    """(path, modified, length) of files that changed after a time; only their names are listed, not their content read."""
    files = spark.read.format("binaryFile").load(pattern).select("path", F.col("modificationTime").alias("modified"), "length")
    return files.where(F.col("modified") > F.lit(since))


def high_water_mark(sink: DataFrame, by: str, ts: str) -> DataFrame:
    """(by, last, n): the newest time and the number of rows that a sink has of each key."""
    return sink.groupBy(by).agg(F.max(ts).alias("last"), F.count("*").alias("n"))


def klines(rows: DataFrame, values: str = "kline") -> DataFrame:
    """Arrays of text, as exchanges send them, as columns: times from epoch milliseconds, prices as DECIMAL(20,8); missing figures are 0."""
    at = lambda name: F.get(F.col(values), KLINE.index(name))
    time = lambda name: F.timestamp_millis(at(name).cast("long"))
    price = lambda name: F.coalesce(at(name).cast("decimal(20,8)"), F.lit(0).cast("decimal(20,8)")).alias(name)
    rest = [c for c in rows.columns if c != values]
    return rows.select(*rest, time("open_time").alias("open_time"), *map(price, ("open", "high", "low", "close", "volume")), time("close_time").alias("close_time"), F.coalesce(at("trades").cast("long"), F.lit(0)).alias("trades"))


#: The exchange's field, the column and its type.
TICKER = (
    ("symbol", "symbol", "string"), ("lastPrice", "price", "double"), ("priceChange", "price_change", "double"), ("priceChangePercent", "price_change_percent", "double"),
    ("highPrice", "high", "double"), ("lowPrice", "low", "double"), ("volume", "volume", "double"), ("quoteVolume", "quote_volume", "double"), ("count", "trade_count", "long"),
)


def tickers(rows: DataFrame, body: str = "body") -> DataFrame:
    """Day statistics of symbols, one or all, from an exchange's JSON: typed columns, null where a figure is missing or no figure."""
    return rows.select(*(F.get_json_object(body, f"$.{field}").try_cast(kind).alias(name) for field, name, kind in TICKER))


def derivatives(rows: DataFrame, body: str = "body") -> DataFrame:
    """(symbol, open_interest, funding_rate, cvd, ts) from a ticker's JSON, whose fields come in two spellings; `cvd` is the quote volume. ts is a column of `rows`."""
    figure = lambda *names: F.coalesce(*(F.get_json_object(body, f"$.{n}").try_cast("double") for n in names))
    pairs = {"open_interest": ("open_interest", "openInterest"), "funding_rate": ("funding_rate", "fundingRate"), "cvd": ("quote_volume", "quoteVolume")}
    return rows.select("symbol", *(figure(*names).alias(c) for c, names in pairs.items()), "ts")


def symbols_batch(rows: DataFrame, wanted: list[str], n: int | None = None, *order: Column) -> DataFrame:
    """Rows of a list of symbols, in any case and named once or more: one scan. With `n`, the first so many of each symbol in an order."""
    from pyspark.sql import Window

    if not wanted or not all(wanted) or (n is not None and n <= 0):
        raise ValueError("symbols and a number above 0 are needed")
    out = rows.where(F.col("symbol").isin(sorted({w.upper() for w in wanted})))
    if n is None:
        return out
    return out.withColumn("__tm_p", F.row_number().over(Window.partitionBy("symbol").orderBy(*order))).where(F.col("__tm_p") <= n).drop("__tm_p")


def restored(spark: SparkSession, path: str, dim: int) -> DataFrame:
    """An archive's rows (text, embedding) from JSON lines, those without a whole vector left out; the archive stays as it is."""
    rows = spark.read.schema("text string, embedding array<float>").json(path)
    return rows.where(F.size("embedding") == dim).select(F.coalesce("text", F.lit("")).alias("text"), "embedding")


def order_book(rows: DataFrame) -> DataFrame:
    """(symbol, side, level, price, qty) from (symbol, bids, asks), arrays of (price, qty)."""
    side = lambda name: rows.select("symbol", F.lit(name[:-1]).alias("side"), F.posexplode(name).alias("level", "q")).select("symbol", "side", "level", F.col("q")[0].cast("decimal(20,8)").alias("price"), F.col("q")[1].cast("decimal(20,8)").alias("qty"))
    return side("bids").unionByName(side("asks"))


def last_candle(rows: DataFrame, array: str = "candles") -> DataFrame:
    """Of each row's array of candles the last."""
    return rows.select(*(c for c in rows.columns if c != array), F.try_element_at(F.col(array), F.lit(-1)).alias("candle"))


def import_records(spark: SparkSession, path: str, kind: str, as_of: datetime) -> DataFrame:
    """Records of CSV (with a header) or JSON files; a missing time is `as_of`, tags are split on commas."""
    reader = spark.read.schema(RECORD)
    rows = reader.option("header", True).csv(path) if kind == "csv" else reader.option("multiLine", True).json(path)
    tags = F.filter(F.transform(F.split(F.coalesce("tags", F.lit("")), ","), F.trim), lambda x: x != "")
    return rows.select("record_id", "source", "content", F.coalesce(F.try_to_timestamp("timestamp"), F.lit(as_of).cast("timestamp")).alias("ts"), "author", tags.alias("tags"))


def symbols(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a text file, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("symbol")).where("symbol <> ''")


def artifacts(spark: SparkSession, patterns: dict[str, str]) -> DataFrame:
    """(path, kind, content) of whole text files by kind and glob pattern."""
    out = None
    for kind, pattern in patterns.items():
        one = spark.read.option("wholetext", True).text(pattern).select(F.col("_metadata.file_path").alias("path"), F.lit(kind).alias("kind"), F.col("value").alias("content"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no pattern")
    return out


def screener(df: DataFrame, columns: list[str], exchange: str, n: int | None = None, *order: str) -> DataFrame:
    """Columns of an exchange's rows: both reach the scan. A limit needs an order to mean anything."""
    out = df.where(F.col("exchange") == exchange)
    out = out.orderBy(*order).limit(n) if n else out
    return out.select(*columns)


def strip_html(html: Column) -> Column:
    """The text of a page: scripts, styles, comments and tags go, entities are read, white space is collapsed."""
    from ..functions.text import ENTITIES

    for pattern in (r"(?is)<(script|style)\b.*?</\1\s*>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    for name, char in ENTITIES:
        html = F.replace(html, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(html, r"\s+", " "))
