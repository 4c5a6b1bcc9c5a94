"""Writers. What must be idempotent is keyed by partition or by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_json(df: DataFrame, path: str, by: str, ts: str, mode: str = "append") -> None:
    """Rows as JSON lines, a folder for each key and day."""
    out = df.withColumn("day", F.date_format(ts, "yyyy-MM-dd"))
    out.repartition(by, "day").write.partitionBy(by, "day").mode(mode).json(path)


def append(df: DataFrame, path: str, *partition: str) -> None:
    """Rows to a Parquet table."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, *partition: str) -> None:
    """Rows in place of all that the partitions they lie in had: writing the same again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def export(df: DataFrame, path: str, kind: str, *, source: str | None = None, tags: list[str] | None = None, n: int | None = None, order: list[str] | None = None, most_chars: int = 500) -> None:
    """Records as json, csv or markdown. All filters come before the limit. In csv tags are joined and content is cut."""
    if source is not None:
        df = df.where(F.col("source") == source)
    if tags:
        df = df.where(F.size(F.array_except(F.array(*map(F.lit, tags)), F.col("tags"))) == 0)
    if n is not None:
        df = df.orderBy(*(order or ["record_id"])).limit(n)
    if kind == "json":
        df.write.mode("overwrite").json(path)
    elif kind == "csv":
        df.withColumn("content", F.substring("content", 1, most_chars)).withColumn("tags", F.array_join("tags", ",")).select("record_id", "source", "ts", "author", "tags", "content").write.mode("overwrite").option("header", True).csv(path)
    elif kind == "markdown":
        head = F.concat(F.lit("## "), F.col("record_id"), F.lit("\n\n- source: "), F.coalesce("source", F.lit("")), F.lit("\n- tags: "), F.array_join("tags", ", "), F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
        df.select(head.alias("value")).write.mode("overwrite").text(path)
    else:
        raise ValueError(f"json, csv or markdown, not {kind!r}")


def graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A small graph as one GraphML file of this machine. Rows are streamed, not collected."""
    from xml.sax.saxutils import quoteattr

    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="directed">\n')
        for r in nodes.select(F.col("id").cast("string")).toLocalIterator():
            f.write(f"<node id={quoteattr(r.id)}/>\n")
        for r in edges.select(F.col("source_id").cast("string"), F.col("target_id").cast("string"), "weight").toLocalIterator():
            f.write(f'<edge source={quoteattr(r.source_id)} target={quoteattr(r.target_id)}><data key="weight">{r.weight}</data></edge>\n')
        f.write("</graph></graphml>\n")


def markdown_table(df: DataFrame, n: int = 50) -> str:
    """The first rows as a Markdown table, for a report."""
    rows = df.limit(n).collect()
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"


def without_chat(nodes: DataFrame, chat: str) -> DataFrame:
    """Nodes (id, tags, properties) that don't belong to a chat: by tag, by property or by id."""
    own = F.coalesce(F.array_contains("tags", chat), F.lit(False)) | F.coalesce(F.get_json_object("properties", "$.chat") == chat, F.lit(False)) | F.col("id").contains(f":{chat}:")
    return nodes.where(~own)


def graphml_parts(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph of any size as GraphML in a folder: `1-head`, `2-nodes`, `3-edges` and `4-tail` hold text files of whole lines, written by tasks.

    The files one after the other, by folder and name, are one GraphML document.
    """
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    spark = nodes.sparkSession
    text = lambda line: spark.range(1, numPartitions=1).select(F.lit(line).alias("value"))
    text('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="weight" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="directed">').write.text(f"{path}/1-head")
    nodes.select(F.concat(F.lit('<node id="'), escaped("id"), F.lit('"/>')).alias("value")).write.text(f"{path}/2-nodes")
    ends = (F.lit('<edge source="'), escaped("source_id"), F.lit('" target="'), escaped("target_id"), F.lit('"><data key="weight">'), F.coalesce(F.col("weight").cast("string"), F.lit("")), F.lit("</data></edge>"))
    edges.select(F.concat(*ends).alias("value")).write.text(f"{path}/3-edges")
    text("</graph></graphml>").write.text(f"{path}/4-tail")
