"""Deduplication that keeps the first of equals, and set operations. What first means is always a total order of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_key(df: DataFrame, key: Column, *order: str, keep_null: bool = True) -> DataFrame:
    """The first row of each key. Rows without a key all stay, or all go.

    By an aggregate of whole rows rather than a window: a key that a third of all rows have is summed up before it is shuffled.
    """
    row = F.struct(*order, *(c for c in df.columns if c not in order))
    first = df.where(key.isNotNull()).groupBy(key.alias("__tm_key")).agg(F.min(row).alias("__tm_row")).select(*(F.col("__tm_row")[c].alias(c) for c in df.columns))
    return first.unionByName(df.where(key.isNull())) if keep_null else first


def consecutive(df: DataFrame, by: str, ts: str, text: Column, more: int = 1, *ties: str) -> DataFrame:
    """Of rows in a row with the same text, the first and `more` repeats."""
    w = Window.partitionBy(by).orderBy(ts, *ties)
    df = df.withColumn("__tm_t", text)
    df = df.withColumn("__tm_new", (~F.col("__tm_t").eqNullSafe(F.lag("__tm_t").over(w)) | (F.row_number().over(w) == 1)).cast("int"))
    df = df.withColumn("__tm_run", F.sum("__tm_new").over(w))
    place = F.row_number().over(Window.partitionBy(by, "__tm_run").orderBy(ts, *ties))
    return df.withColumn("__tm_p", place).where(F.col("__tm_p") <= 1 + more).drop("__tm_t", "__tm_new", "__tm_run", "__tm_p")


def duplicate_rate(df: DataFrame, text: Column, *by: str) -> DataFrame:
    """1 minus distinct by all texts, in lower case and trimmed, to three digits; 0 without rows."""
    key = F.lower(F.trim(text))
    return df.groupBy(*by).agg(F.round(1 - F.count_distinct(key) / F.count(key), 3).alias("duplicate_rate"))


def upsert(current: DataFrame, changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """The latest row of each key over both tables; of equal versions a change wins."""
    both = current.withColumn("__tm_new", F.lit(0)).unionByName(changes.withColumn("__tm_new", F.lit(1)))
    row = F.struct(version, "__tm_new", *(c for c in current.columns if c != version))
    return both.groupBy(*key).agg(F.max(row).alias("__tm_row")).select(*(F.col("__tm_row")[c].alias(c) for c in current.columns))


def insert_absent(current: DataFrame, new: DataFrame, key: list[str], *order: str) -> DataFrame:
    """Rows whose key is not there yet, the first of each: existing rows never change."""
    fresh = new.join(current.select(*key).distinct(), key, "left_anti")
    row = F.struct(*order, *(c for c in new.columns if c not in order))
    return fresh.groupBy(*key).agg(F.min(row).alias("__tm_row")).select(*(F.col("__tm_row")[c].alias(c) for c in new.columns))


def delete_with_status(current: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What is left, and (key, status: deleted or missing) of each id that was asked for."""
    asked = ids.select(key).distinct()
    found = current.select(key).distinct().withColumn("__tm_f", F.lit(True))
    status = asked.join(found, key, "left").select(key, F.when(F.col("__tm_f"), "deleted").otherwise("missing").alias("status"))
    return current.join(asked, key, "left_anti"), status


def newest(df: DataFrame, by: str, ts: str, most: int, *ties: str) -> DataFrame:
    """The newest `most` rows of each group."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(ts), *map(F.desc, ties)))
    return df.withColumn("__tm_p", place).where(F.col("__tm_p") <= most).drop("__tm_p")


def update_with_status(current: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The table with the changes' values where they aren't null, and (key, status: updated or missing) of each change. Keys don't repeat."""
    columns = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"__tm_{c}") for c in columns))
    out = current.join(new, key, "left").withColumns({c: F.coalesce(f"__tm_{c}", c) for c in columns}).select(*current.columns)
    found = current.select(key).withColumn("__tm_f", F.lit(True))
    status = changes.select(key).join(found, key, "left").select(key, F.when(F.col("__tm_f"), "updated").otherwise("missing").alias("status"))
    return out, status
