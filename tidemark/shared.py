"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}  # by application, where the session names no folder
_LEFT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs on one machine, as in tests, a temporary folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _OWN[app]


def new_path(spark: SparkSession, what: str = "table") -> str:
    """A path in the shared folder that no other run uses; deleted when the driver ends, if its session still runs then."""
    path = f"{shared_dir(spark)}/tidemark/{what}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _LEFT.pop(path, None)


def materialized(df: DataFrame, what: str = "table") -> DataFrame:
    """The same rows from a table in the shared folder: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._tidemark_path = path
    return read


def forget(*tables: DataFrame) -> None:
    """Deletes tables that materialized() wrote and that nothing reads any more; others are left alone."""
    for table in tables:
        if path := getattr(table, "_tidemark_path", None):
            delete(table.sparkSession, path)


@atexit.register
def _clean() -> None:
    for path, spark in list(_LEFT.items()):
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001, PERF203  this session has ended before
            continue
