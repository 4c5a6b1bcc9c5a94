"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}  # by application, where the session names no folder
_LEFT: list[tuple[SparkSession, str]] = []


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
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that no other run uses. It is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/tidemark/{what}-{uuid.uuid4().hex}"
    _LEFT.append((spark, path))
    return path


def hadoop_fs(spark: SparkSession, path: str):  # noqa: ANN201  (a Java object)
    """Hadoop's file system of a path, and the path as Hadoop has it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = hadoop_fs(spark, path)
    fs.delete(at, True)


def materialize(df: DataFrame, what: str) -> DataFrame:
    """The same rows from a written table: lineage ends here, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._tidemark_path = path
    return table


#: Copies of a repeated row that one row is unfolded to at once.
UNFOLD = 65_536


def numbered(rows: DataFrame) -> DataFrame:
    """The same rows with `copy`, which tells repeated ones apart: 1, 2 and so on.

    Repeated rows are counted before they are shuffled, and unfolded again in parts that are dealt to all tasks.
    """
    counted = materialize(rows.groupBy(*rows.columns).agg(F.count("*").alias("__tm_n")), "counted")
    once = counted.where("__tm_n = 1").select(*rows.columns, F.lit(1).cast("long").alias("copy"))
    return once.unionByName(unfolded(counted.where("__tm_n > 1"), F.col("__tm_n"), "copy").drop("__tm_n"))


def unfolded(rows: DataFrame, n: Column, name: str) -> DataFrame:
    """Each row n times, with the numbers from 1 to n in the column `name`: in parts, which are dealt to all tasks."""
    parts = rows.withColumn("__tm_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / UNFOLD))))
    first = F.col("__tm_k") * UNFOLD + 1
    return parts.repartition(*parts.columns).withColumn(name, F.explode(F.sequence(first, F.least(first + (UNFOLD - 1), n)))).drop("__tm_k")


def forget(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and that nothing reads any more."""
    for table in tables:
        roots = {f.rpartition("/")[0] for f in table.inputFiles()}
        for root in roots:
            if "/tidemark/" in root:
                delete(table.sparkSession, root)


def made() -> int:
    """How many paths new_path() has given out: what `forget_made` takes."""
    return len(_LEFT)


def forget_made(since: int, *keep: DataFrame) -> None:
    """Deletes all that was written since then, but for the tables to keep: for an operator whose result is a table of its own."""
    held = {getattr(table, "_tidemark_path", None) for table in keep}
    for spark, path in _LEFT[since:]:
        if path not in held:
            delete(spark, path)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over: it does so when the driver's JVM finds that nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame, what: str) -> DataFrame:
    """The rows from a written table; the shuffle files behind it can go."""
    table = materialize(df, what)
    release_shuffles(df.sparkSession)
    return table


def asked_for(rows: DataFrame, asked: DataFrame, key: str, most: int = 1 << 18) -> DataFrame:
    """The rows whose key is asked for, and some others: so that a join needn't shuffle the texts of all.

    A bit for each number that a key has; the table of bits has `most` rows of 64 at most, whatever is asked, and is broadcast.
    """
    number = F.pmod(F.xxhash64(key), F.lit(64 * most))
    bit = F.expr("shiftleft(1L, cast(__tm_number & 63 as int))")
    bits = asked.select(number.alias("__tm_number")).select(F.shiftright("__tm_number", 6).alias("__tm_word"), bit.alias("__tm_bit")).groupBy("__tm_word").agg(F.bit_or("__tm_bit").alias("__tm_bits"))
    held = rows.withColumn("__tm_number", number).withColumn("__tm_word", F.shiftright("__tm_number", 6)).join(F.broadcast(bits), "__tm_word")
    return held.where(F.col("__tm_bits").bitwiseAND(bit) != 0).select(*rows.columns)


@atexit.register
def _clean() -> None:
    for spark, path in _LEFT:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001, PERF203  the session has ended before
            return
