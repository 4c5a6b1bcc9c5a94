"""Column functions on JSON text and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fenced(text: Column) -> Column:
    """JSON text without a code fence around it; null if it isn't JSON."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))
    return F.when(F.try_parse_json(bare).isNotNull(), bare)


def truthy(text: Column, path: str) -> Column:
    """Whether what a path leads to is there and neither false, null, 0 nor empty."""
    value = F.get_json_object(text, path)
    return F.coalesce(~F.lower(value).isin("", "false", "null", "0", "0.0", "[]", "{}"), F.lit(False))


def cache_key(*columns: Column) -> Column:
    """SHA-256 of the values as JSON, with their names in order."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def event_id(id_: Column, topic: Column, payload: Column) -> Column:
    """The id, or topic and a hash of the payload."""
    return F.coalesce(id_.cast("string"), F.concat_ws(":", topic, F.xxhash64(payload).cast("string")))
