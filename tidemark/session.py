"""The settings that the library expects of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Set on every session that reads tables: results must not depend on a machine's zone.
SETTINGS = {"spark.sql.session.timeZone": "UTC"}

#: For sessions that this library builds itself.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[*]", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A session for one machine, as tests and bench use it; a cluster's session comes from outside."""
    conf = SETTINGS | DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions)} | more
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()


def configured(spark: SparkSession) -> SparkSession:
    """The same session with the settings that results depend on."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark
