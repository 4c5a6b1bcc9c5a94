"""Places in an order of all rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import materialized

_BITS = 33  # of a monotonically increasing id, the place within a partition


def ranked(df: DataFrame, *order: Column | str, out: str = "rank", total: str | None = None) -> DataFrame:
    """Adds `out`, each row's place from 1 in an order without ties, and `total`, the number of rows, if it has a name.

    Rows are sorted into ranges and written; then only the ranges' sizes, a row for each partition, are added up in one task.
    """
    held = materialized(df.orderBy(*order).withColumn("__tm_m", F.monotonically_increasing_id()))
    part = F.shiftright("__tm_m", _BITS)
    sizes = held.groupBy(part.alias("__tm_k")).agg(F.count("*").alias("__tm_n"))
    before = F.coalesce(F.sum("__tm_n").over(Window.orderBy("__tm_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__tm_k", before.alias("__tm_b"), F.sum("__tm_n").over(Window.partitionBy()).alias("__tm_t"))
    joined = held.join(F.broadcast(sizes), part == F.col("__tm_k"))
    place = F.col("__tm_b") + F.col("__tm_m").bitwiseAND(F.lit((1 << _BITS) - 1)) + 1
    more = {total: F.col("__tm_t")} if total else {}
    return joined.withColumns({out: place, **more}).drop("__tm_m", "__tm_k", "__tm_b", "__tm_t")
