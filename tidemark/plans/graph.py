"""Queries over property graphs, sessions and learned patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import learning as L
from ..operators import paths as P
from ..operators import sessions as N
from ..sources.tables import FACTS_SQL, MESSAGES_SQL, facts, load, messages
from .registry import query

# Suppliers and kinds of parts as a graph: an edge from a supplier to each kind that a line of an order has from it. Kinds are 100000 and up; some of
# them have no node, and some nodes no edge. Searches start from all suppliers whose key is divisible by 20.
_EDGES = "SELECT DISTINCT l_suppkey AS source_id, 100000 + l_partkey % 300 AS target_id, CASE WHEN l_linenumber % 2 = 0 THEN 'SUPPLIES' ELSE 'OFFERS' END AS type, 0.5 AS weight FROM lineitem"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem")
    kind = F.when(F.col("l_linenumber") % 2 == 0, "SUPPLIES").otherwise("OFFERS")
    return rows.select(F.col("l_suppkey").alias("source_id"), (F.lit(100000) + F.col("l_partkey") % 300).alias("target_id"), kind.alias("type"), F.lit(0.5).alias("weight")).distinct()


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "supplier").select(F.col("s_suppkey").alias("id")).union(spark.range(100010, 100310))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "supplier").where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("id"))


_NODES = "SELECT s_suppkey AS id FROM supplier UNION ALL SELECT * FROM range(100010, 100310)"


@query(f"WITH e AS ({_EDGES}), n AS ({_NODES}) SELECT source_id, target_id, type FROM e WHERE source_id IN (SELECT id FROM n) AND target_id IN (SELECT id FROM n)")
def edge_endpoint_validation(spark: SparkSession, d: str) -> DataFrame:
    return G.valid_edges(_nodes(spark, d), _edges(spark, d)).select("source_id", "target_id", "type")


@query(f"WITH e AS ({_EDGES}) SELECT source_id, target_id, min(type) AS type FROM e GROUP BY 1, 2")
def first_edge_per_pair(spark: SparkSession, d: str) -> DataFrame:
    return G.first_edges(_edges(spark, d), "type").select("source_id", "target_id", "type")


@query(f"WITH e AS ({_EDGES}), n AS ({_NODES}) SELECT id FROM n WHERE id NOT IN (SELECT source_id FROM e UNION SELECT target_id FROM e)")
def orphan_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.orphans(_nodes(spark, d), _edges(spark, d))[0]


@query(f"WITH e AS ({_EDGES}), n AS ({_NODES}) SELECT source_id, target_id, type FROM e WHERE target_id NOT IN (SELECT id FROM n) OR source_id NOT IN (SELECT id FROM n)")
def orphan_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.orphans(_nodes(spark, d), _edges(spark, d))[1].select("source_id", "target_id", "type")


@query(f"WITH e AS ({_EDGES}), s AS (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 20 = 0) SELECT source_id AS id, target_id AS neighbor, type FROM e WHERE source_id IN (SELECT id FROM s) UNION ALL SELECT target_id, source_id, type FROM e WHERE target_id IN (SELECT id FROM s)")
def graph_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbors(_edges(spark, d), _seeds(spark, d)).select("id", "neighbor", "type")


@query(f"WITH e AS ({_EDGES}) SELECT source_id, target_id, type FROM e WHERE source_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND target_id IN (SELECT * FROM range(100010, 100310))")
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    solvent = load(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"))
    ids = solvent.union(spark.range(100010, 100310))
    return G.induced(_edges(spark, d), ids).select("source_id", "target_id", "type")


@query(f"""WITH RECURSIVE e AS ({_EDGES}), b AS (SELECT source_id AS x, target_id AS y FROM e UNION SELECT target_id, source_id FROM e), r AS (SELECT s_suppkey AS seed, s_suppkey AS id, 0 AS hops FROM supplier WHERE s_suppkey % 20 = 0 UNION SELECT seed, y, hops + 1 FROM r JOIN b ON x = id WHERE hops < 3)
  SELECT seed, id, min(hops) AS hops FROM r GROUP BY 1, 2""")
def k_hop_related(spark: SparkSession, d: str) -> DataFrame:
    return G.k_hop(_edges(spark, d), _seeds(spark, d), 3)


_FLOW = "SELECT o_custkey % 200 AS source_id, o_orderkey % 200 AS target_id, min(o_totalprice) / 500000 AS weight FROM orders WHERE o_custkey % 200 <> o_orderkey % 200 GROUP BY 1, 2"


def _flow(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select((F.col("o_custkey") % 200).alias("source_id"), (F.col("o_orderkey") % 200).alias("target_id"), "o_totalprice").where("source_id <> target_id")
    return rows.groupBy("source_id", "target_id").agg((F.min("o_totalprice") / 500000).alias("weight")).withColumn("type", F.lit("FLOW"))


@query(f"""WITH RECURSIVE e AS ({_FLOW}), r AS (SELECT range AS seed, range AS id, 0.0::DOUBLE AS cost, 0 AS hops FROM range(0, 200, 20) UNION ALL (SELECT seed, target_id, min(cost + weight), hops + 1 FROM r JOIN e ON source_id = id WHERE hops < 3 GROUP BY seed, target_id, hops))
  SELECT seed, id, round(min(cost), 8) AS cost FROM r GROUP BY 1, 2""")
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """Weights are multiples of 2e-8, and so are costs: at eight digits nothing is halfway."""
    seeds = spark.range(0, 200, 20)
    return G.shortest_paths(_flow(spark, d), seeds, 3).select("seed", "id", F.round("cost", 8).alias("cost"))


# Components by definition: each id, a node or the end of an edge, and all that it reaches.
@query(f"""
WITH RECURSIVE e AS ({_EDGES}), n AS ({_NODES}),
  b AS (SELECT source_id AS x, target_id AS y FROM e UNION SELECT target_id, source_id FROM e),
  every AS (SELECT id FROM n UNION SELECT x FROM b),
  g AS (SELECT id, id AS reach FROM every UNION SELECT g.id, b.y FROM g JOIN b ON b.x = g.reach),
  c AS (SELECT id, min(reach) AS k FROM g GROUP BY id),
  t AS (SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(DISTINCT k) FROM c) AS components)
SELECT n_nodes, n_edges, round(2 * n_edges / n_nodes, 6) AS avg_degree, round(n_edges / (n_nodes * (n_nodes - 1)), 6) AS density, components FROM t""")
def graph_statistics(spark: SparkSession, d: str) -> DataFrame:
    return G.stats(_nodes(spark, d), _edges(spark, d)).withColumns({"avg_degree": F.round("avg_degree", 6), "density": F.round("density", 6)})


@query(f"WITH e AS ({_EDGES}), x AS (SELECT source_id AS id FROM e UNION ALL SELECT target_id FROM e), g AS (SELECT id, count(*) AS degree FROM x GROUP BY 1) SELECT id, degree, round(degree / max(degree) OVER (), 6) AS centrality FROM g")
def degree_centrality(spark: SparkSession, d: str) -> DataFrame:
    return G.degree_centrality(_edges(spark, d)).withColumn("centrality", F.round("centrality", 6))


# Walks by length: those of the least length between two nodes are their shortest paths. A node is on as many of them as the product of
# the paths from either end, where the distances add up. Suppliers and kinds are never more than six steps apart.
@query(f"""
WITH RECURSIVE e AS ({_EDGES}), n AS ({_NODES}),
  b AS MATERIALIZED (SELECT source_id AS x, target_id AS y FROM e UNION SELECT target_id, source_id FROM e),
  every AS (SELECT id FROM n UNION SELECT x FROM b),
  w AS (SELECT x AS s, x AS t, 0 AS h, 1.0::DOUBLE AS k FROM (SELECT DISTINCT x FROM b)
        UNION ALL
        SELECT s, y, h + 1, sum(k) FROM w JOIN b ON x = t WHERE h < 6 GROUP BY s, y, h),
  p AS MATERIALIZED (SELECT s, t, min(h) AS far, arg_min(k, h) AS paths FROM w GROUP BY s, t),
  v AS (SELECT i.t AS id, sum(i.paths * o.paths / p.paths) AS share
        FROM p i JOIN p o ON o.s = i.t JOIN p ON p.s = i.s AND p.t = o.t AND p.far = i.far + o.far
        WHERE i.s <> i.t AND o.s <> o.t AND i.s <> o.t GROUP BY 1)
SELECT every.id, round(coalesce(share, 0) / ((SELECT count(*) FROM every) - 1) / ((SELECT count(*) FROM every) - 2), 8) AS betweenness
FROM every LEFT JOIN v ON v.id = every.id""")
def betweenness_centrality(spark: SparkSession, d: str) -> DataFrame:
    return P.betweenness(_nodes(spark, d), _edges(spark, d)).withColumn("betweenness", F.round("betweenness", 8))


_BONDS = """SELECT l_suppkey AS source_id, 100000 + l_partkey % 300 AS target_id, max(l_returnflag) AS type, max(l_discount) + 0.5 AS weight FROM lineitem GROUP BY 1, 2"""


# All ways of one and of three steps (both ends are of different kinds, so that there are none of two), the best three of each pair.
@query(f"""
WITH e AS MATERIALIZED ({_BONDS}),
  pair AS (SELECT s_suppkey AS s, 100000 + s_suppkey % 300 AS t FROM supplier WHERE s_suppkey % 20 = 0),
  p AS (
  SELECT s, t, 1 AS length, weight AS strength, [s, t] AS nodes, [type] AS types FROM pair JOIN e ON source_id = s AND target_id = t
  UNION ALL
  SELECT s, t, 3, a.weight * b.weight * c.weight, [s, a.target_id, b.source_id, t], [a.type, b.type, c.type]
  FROM pair JOIN e a ON a.source_id = s JOIN e b ON b.target_id = a.target_id JOIN e c ON c.source_id = b.source_id AND c.target_id = t
  WHERE a.target_id <> t AND b.source_id <> s),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY s, t ORDER BY length, round(strength, 9) DESC, nodes) AS INTEGER) AS rank FROM p)
SELECT s AS source, t AS target, rank, length, round(strength, 6) AS strength, nodes, types FROM r WHERE rank <= 3""")
def best_paths(spark: SparkSession, d: str) -> DataFrame:
    """The three best ways from each twentieth supplier to a kind of part, over suppliers and kinds alike."""
    rows = load(spark, d, "lineitem")
    bonds = rows.groupBy(F.col("l_suppkey").alias("source_id"), (F.lit(100000) + F.col("l_partkey") % 300).alias("target_id")).agg(F.max("l_returnflag").alias("type"), (F.max("l_discount") + 0.5).alias("weight"))
    pairs = _seeds(spark, d).select(F.col("id").alias("source"), (F.lit(100000) + F.col("id") % 300).alias("target"))
    return P.find_paths(bonds, pairs, directed=False).withColumn("strength", F.round("strength", 6))


@query(f"""WITH RECURSIVE e AS ({_FLOW}), o AS (SELECT source_id, sum(weight) AS total FROM e GROUP BY 1), s AS (SELECT e.source_id, target_id, weight / total AS share FROM e JOIN o USING (source_id)), n AS (SELECT DISTINCT id FROM (SELECT source_id AS id FROM e UNION SELECT target_id FROM e)),
  r AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank, 0 AS k FROM n UNION ALL SELECT n.id, 0.15::DOUBLE / (SELECT count(*) FROM n) + 0.85::DOUBLE * coalesce(sum(r.rank * s.share), 0), max(t.k) + 1 FROM (SELECT DISTINCT k FROM r) t CROSS JOIN n LEFT JOIN s ON s.target_id = n.id LEFT JOIN r ON r.id = s.source_id WHERE t.k < 20 GROUP BY n.id)
  SELECT id, round(rank, 8) AS rank FROM r WHERE k = 20""")
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    e = _flow(spark, d)
    nodes = e.select(F.col("source_id").alias("id")).union(e.select("target_id"))
    return G.pagerank(nodes, e, turns=20, tolerance=0.0).withColumn("rank", F.round("rank", 8))


@query(f"""WITH m AS ({MESSAGES_SQL}), l AS (SELECT id AS source_id, lead(id) OVER w AS target_id, date_sub('second', ts, lead(ts) OVER w) / 60 AS gap FROM m WINDOW w AS (PARTITION BY chat ORDER BY ts, id)) SELECT source_id, target_id, round(1 - gap / 60, 6) AS weight FROM l WHERE target_id IS NOT NULL AND gap <= 60""")
def temporal_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.temporal_edges(messages(spark, d), ["chat"], "id", "ts", 60).withColumn("weight", F.round("weight", 6))


@query()
def adjacent_record_links(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).withColumns({"entities": F.array(F.get_json_object(F.split_part("text", F.lit(" "), F.lit(2)), "$.k")), "tags": F.array(F.split_part("text", F.lit(" "), F.lit(1)))})
    return G.adjacent_links(rows, ["chat"], "id", "ts", "entities", "tags", "author")


_GAP = f"m AS ({MESSAGES_SQL}), g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) > {{us}} THEN 1 ELSE 0 END AS nw FROM m WINDOW w AS (PARTITION BY chat ORDER BY ts, id)), s AS (SELECT *, sum(nw) OVER (PARTITION BY chat ORDER BY ts, id) AS session_no FROM g)"


@query(f"WITH {_GAP.format(us=600_000_000)} SELECT id, chat, CAST(session_no AS BIGINT) AS session_no FROM s")
def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    return N.gap_sessions(messages(spark, d), "chat", "ts", 10, "id").select("id", "chat", "session_no")


@query(f"WITH {_GAP.format(us=600_000_000)} SELECT chat, CAST(s.session_no AS BIGINT) AS session_no, chat || '-S' || lpad(CAST(s.session_no + 1 AS VARCHAR), 4, '0') AS session_id, count(*) AS n, round(date_sub('second', min(ts), max(ts)) / 60, 1) AS minutes, list_sort(list(DISTINCT author)) AS participants FROM s GROUP BY chat, s.session_no")
def session_summaries(spark: SparkSession, d: str) -> DataFrame:
    out = N.session_summary(N.gap_sessions(messages(spark, d), "chat", "ts", 10, "id"), "chat", "ts", "author")
    return out.select("chat", "session_no", "session_id", "n", "minutes", "participants")


@query()
def capped_sessions(spark: SparkSession, d: str) -> DataFrame:
    return N.capped_sessions(messages(spark, d), "chat", "ts", "id", gap_minutes=30, most_hours=6).select("id", "chat", "session_no")


@query()
def message_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).withColumn("reply_to", F.when(F.col("id") % 5 == 0, F.col("id") - 10))
    return N.chunks(rows, "chat", "ts", "id", most_tokens=60, gap_minutes=30).select("id", "chat", "chunk_no")


@query()
def chunks_by_table_function(spark: SparkSession, d: str) -> DataFrame:
    """The same chunks, by a table function in SQL; tests hold it against the operator."""
    from ..operators import indexing

    indexing.register(spark, "tidemark_chunks", most_tokens=60, gap_minutes=30)
    messages(spark, d).withColumn("reply_to", F.when(F.col("id") % 5 == 0, F.col("id") - 10)).createOrReplaceTempView("tidemark_messages")
    return spark.sql("""
        SELECT chat, chunk_no, size(ids) AS n, start, end, md5(text) AS digest
        FROM tidemark_chunks(TABLE(SELECT chat, id, ts, author, text, reply_to FROM tidemark_messages) PARTITION BY chat ORDER BY (ts, id))""")


@query(f"""WITH m AS (SELECT *, length(text) <= 16 AS short FROM ({MESSAGES_SQL})), j AS (SELECT *, CASE WHEN short AND lag(short) OVER w AND date_diff('microsecond', lag(ts) OVER w, ts) <= 3600000000 THEN 0 ELSE 1 END AS nw FROM m WINDOW w AS (PARTITION BY chat ORDER BY ts, id)),
  r AS (SELECT *, sum(nw) OVER (PARTITION BY chat ORDER BY ts, id) AS run FROM j) SELECT chat, min(ts) AS ts, trim(string_agg(text, ' ' ORDER BY ts, id)) AS text, count(*) AS n FROM r GROUP BY chat, run""")
def merge_short_messages(spark: SparkSession, d: str) -> DataFrame:
    return N.merge_short(messages(spark, d), "chat", "ts", "text", "id", most=16, within_seconds=3600)


@query(f"WITH {_GAP.format(us=14_400_000_000)} SELECT chat, CAST(session_no AS BIGINT) AS session_no, count(*) AS n FROM s GROUP BY 1, 2")
def natural_breaks(spark: SparkSession, d: str) -> DataFrame:
    return N.day_groups(messages(spark, d), "chat", "ts", "id").groupBy("chat", "session_no").agg(F.count("*").alias("n"))


@query(f"SELECT chat, CAST(p // 100 AS BIGINT) AS part_no, count(*) AS n FROM (SELECT chat, row_number() OVER (PARTITION BY chat ORDER BY ts, id) - 1 AS p FROM ({MESSAGES_SQL})) GROUP BY 1, 2")
def fixed_count_split(spark: SparkSession, d: str) -> DataFrame:
    return N.fixed_count(messages(spark, d), "chat", ["ts", "id"], 100).groupBy("chat", "part_no").agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE d AS (SELECT chat, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM ({MESSAGES_SQL}) GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY day) AS k FROM d),
  f AS (SELECT chat, day, n, k, n AS held, 0::BIGINT AS merged_no FROM o WHERE k = 1 UNION ALL SELECT o.chat, o.day, o.n, o.k, CASE WHEN f.held >= 80 THEN o.n ELSE f.held + o.n END, CASE WHEN f.held >= 80 THEN f.merged_no + 1 ELSE f.merged_no END FROM f JOIN o ON o.chat = f.chat AND o.k = f.k + 1) SELECT chat, day, n, merged_no FROM f""")
def days_until_minimum(spark: SparkSession, d: str) -> DataFrame:
    days = messages(spark, d).groupBy("chat", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return N.until_minimum(days, "chat", "day", "n", 80)


@query(f"""WITH RECURSIVE d AS (SELECT chat, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM ({MESSAGES_SQL}) GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY day) AS k FROM d),
  f AS (SELECT chat, day, n, k, n AS held, 0::BIGINT AS merged_no FROM o WHERE k = 1 UNION ALL SELECT o.chat, o.day, o.n, o.k, CASE WHEN f.held + o.n > 100 THEN o.n ELSE f.held + o.n END, CASE WHEN f.held + o.n > 100 THEN f.merged_no + 1 ELSE f.merged_no END FROM f JOIN o ON o.chat = f.chat AND o.k = f.k + 1) SELECT chat, day, n, merged_no FROM f""")
def token_budget_merge(spark: SparkSession, d: str) -> DataFrame:
    days = messages(spark, d).groupBy("chat", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return N.within_budget(days, "chat", "day", "n", 100)


@query()
def symmetric_context(spark: SparkSession, d: str) -> DataFrame:
    return N.symmetric_context(messages(spark, d), "chat", "ts", "text", "id", each=3, most_chars=60).select("id", "context")


@query(f"WITH m AS ({MESSAGES_SQL}), g AS (SELECT chat, date_sub('second', lag(ts) OVER (PARTITION BY chat ORDER BY ts, id), ts) / 3600 AS h FROM m) SELECT chat, round(avg(h), 6) AS avg_hours, round(max(h), 6) AS max_hours, round(min(h), 6) AS min_hours, count(*) FILTER (h > 24) AS over_day, count(*) FILTER (h > 168) AS over_week FROM g WHERE h IS NOT NULL GROUP BY 1")
def silence_statistics(spark: SparkSession, d: str) -> DataFrame:
    return N.silence(messages(spark, d), "chat", "ts", "id").withColumns({c: F.round(c, 6) for c in ("avg_hours", "max_hours", "min_hours")})


@query(f"WITH a AS (SELECT chat, count(*) / greatest(date_sub('second', min(ts), max(ts)) / 86400, 1) AS p FROM ({MESSAGES_SQL}) GROUP BY 1) SELECT chat, round(p, 6) AS per_day, CASE WHEN p > 50 THEN 'high' WHEN p > 10 THEN 'medium' ELSE 'low' END AS level FROM a")
def activity_estimation(spark: SparkSession, d: str) -> DataFrame:
    return N.activity(messages(spark, d), "chat", "ts").withColumn("per_day", F.round("per_day", 6))


@query(f"SELECT chat, CASE WHEN count(author) / count(*) < 0.3 THEN 'channel' WHEN count(DISTINCT author) > 5 THEN 'group' ELSE 'chat' END AS kind FROM ({MESSAGES_SQL}) GROUP BY 1")
def chat_type_detection(spark: SparkSession, d: str) -> DataFrame:
    return N.chat_type(messages(spark, d), "chat", "author")


@query(f"SELECT chat, value, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY chat ORDER BY n DESC, value) AS r FROM (SELECT chat, CAST(hour(ts) AS INTEGER) AS value, count(*) AS n FROM ({MESSAGES_SQL}) GROUP BY 1, 2)) WHERE r <= 5")
def peak_hours(spark: SparkSession, d: str) -> DataFrame:
    return N.peak(messages(spark, d), "chat", F.hour("ts"), 5)


_F = f"f AS (SELECT *, 1 + CAST(json_extract(payload, '$.k') AS BIGINT) % 5 AS plan_steps, value / 10 AS duration, value / 500 AS confidence FROM ({FACTS_SQL}))"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    steps = 1 + F.get_json_object("payload", "$.k").cast("long") % 5
    return facts(spark, d).withColumns({"plan_steps": steps, "duration": F.col("value") / 10, "confidence": F.col("value") / 500})


@query(f"""WITH {_F}, g AS (SELECT correlation_id, count(*) FILTER (kind = 'Fact:Execution') AS n, arg_min(plan_steps, (ts, id)) FILTER (kind = 'Fact:Plan') AS ps, avg(duration) FILTER (kind = 'Fact:Execution') AS ad, max(duration) FILTER (kind = 'Fact:Execution') AS md,
  count(*) FILTER (kind = 'Fact:Error') AS er, coalesce(bool_or(success) FILTER (kind = 'Fact:Outcome'), false) AS ok, coalesce(arg_min(confidence, (ts, id)) FILTER (kind = 'Fact:Outcome'), 0) AS cf, epoch_us(max(ts) FILTER (kind = 'Fact:Execution')) - epoch_us(min(ts) FILTER (kind = 'Fact:Execution')) AS us, count(*) FILTER (kind = 'Fact:Execution' AND success) AS good FROM f GROUP BY 1)
  SELECT correlation_id, coalesce(ps, n) AS plan_steps, round(ad, 6) AS avg_duration, round(md, 6) AS max_duration, er AS error_count, greatest(0, n - coalesce(ps, n)) AS retry_count, ok::INT AS outcome_success, round(cf, 6) AS outcome_confidence, round(us / 1e6 + 1e-8, 4) AS execution_span_seconds, (good >= n / 2)::INT AS label FROM g WHERE n > 0""")
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    return L.feature_matrix(_facts(spark, d)).withColumns({"avg_duration": F.round("avg_duration", 6), "max_duration": F.round("max_duration", 6), "outcome_confidence": F.round("outcome_confidence", 6), "execution_span_seconds": F.round(F.col("execution_span_seconds") + 1e-8, 4)})


_P = f"""{_F}, g AS (SELECT correlation_id, count(*) FILTER (kind = 'Fact:Execution') AS n, coalesce(arg_min(plan_steps, (ts, id)) FILTER (kind = 'Fact:Plan'), 0) AS ps, count(*) FILTER (kind = 'Fact:Plan') AS pl, count(*) FILTER (kind = 'Fact:Error') AS er, count(*) FILTER (kind = 'Fact:Execution' AND success) AS good FROM f GROUP BY 1 HAVING pl > 0),
  p AS (SELECT correlation_id, CASE WHEN n = 0 THEN 'neutral' WHEN good >= n * 0.8 THEN 'success' WHEN er > 0 OR good < n * 0.5 THEN 'failure' ELSE 'neutral' END AS pattern_type, ps AS plan_steps, er > 0 AS has_errors, greatest(0, n - ps) AS retry_count, CASE WHEN n > 0 THEN good / n ELSE 0 END AS success_rate, er AS error_count, CASE WHEN ps > 0 THEN n / ps ELSE 0 END AS completion_rate, greatest(0, least(10, n) - er) AS tenths FROM g)"""


@query(f"WITH {_P} SELECT correlation_id, pattern_type, plan_steps, has_errors, retry_count, round(success_rate, 6) AS success_rate, error_count, round(completion_rate, 6) AS completion_rate FROM p")
def pattern_identification(spark: SparkSession, d: str) -> DataFrame:
    return L.patterns(_facts(spark, d)).drop("confidence").withColumns({"success_rate": F.round("success_rate", 6), "completion_rate": F.round("completion_rate", 6)})


@query(f"WITH {_P} SELECT plan_steps, has_errors, retry_count, count(*) AS frequency, arg_min(pattern_type, correlation_id) AS pattern_type, round(avg(success_rate), 6) AS success_rate FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 5 AND sum(tenths) >= count(*)")
def pattern_aggregation(spark: SparkSession, d: str) -> DataFrame:
    out = L.pattern_groups(L.patterns(_facts(spark, d)), 5, 0.1)
    return out.select("plan_steps", "has_errors", "retry_count", "frequency", "pattern_type", F.round("success_rate", 6).alias("success_rate"))


@query()
def random_forest_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Groups of facts, each predicted by a forest that has seen no group of its fold."""
    columns = ["plan_steps", "avg_duration", "error_count", "retry_count", "outcome_success"]
    rows, _ = L.cross_validated(L.feature_matrix(_facts(spark, d)), columns, "correlation_id", trees=(5, 10), depths=(3, 5, 8), leaves=(1, 2))
    return rows.select("correlation_id", "label", "fold", "prediction")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(F.concat(F.lit("p"), (F.col("o_custkey") % 50).cast("string")).alias("profile_id"), F.col("o_orderkey").alias("version_id"), (F.col("o_orderstatus") != "F").alias("active"), F.create_map(F.lit("max_price"), F.col("o_totalprice"), F.col("o_orderpriority"), F.lit(1.0)).alias("rules"))


@query("SELECT 'p' || CAST(o_custkey % 50 AS VARCHAR) AS profile_id, max(o_orderkey) AS version_id, arg_max(o_orderstatus <> 'F', o_orderkey) AS active FROM orders GROUP BY 1")
def current_profiles(spark: SparkSession, d: str) -> DataFrame:
    return L.current_profiles(_versions(spark, d).drop("rules")).select("profile_id", "version_id", "active")


@query("""WITH c AS (SELECT 'p' || CAST(o_custkey % 50 AS VARCHAR) AS profile_id, arg_max(o_orderstatus <> 'F', o_orderkey) AS active, arg_max(o_orderpriority, o_orderkey) AS prio FROM orders GROUP BY 1)
  SELECT c_custkey AS request_id, CASE WHEN active THEN 'allow' ELSE 'deny' END AS decision, CASE WHEN active THEN [prio, 'max_price'] ELSE [] END AS rules FROM customer LEFT JOIN c ON profile_id = 'p' || CAST(c_custkey % 60 AS VARCHAR)""")
def policy_decision(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d)
    newest = v.groupBy("profile_id").agg(F.max("version_id").alias("version_id"))
    asked = load(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.concat(F.lit("p"), (F.col("c_custkey") % 60).cast("string")).alias("profile_id"))
    return L.decide(asked, v.join(newest, ["profile_id", "version_id"]))


@query("SELECT event_id, user_id, count(*) OVER w AS n, round(avg(value) OVER w + 1e-9, 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_mean_per_user(spark: SparkSession, d: str) -> DataFrame:
    return L.running_mean(load(spark, d, "events"), "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", "n", F.round(F.col("mean") + 1e-9, 6).alias("mean"))


@query("SELECT s_name, n_name, r_name, s_acctbal FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dimension_lookup(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (load(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").join(r, n["n_regionkey"] == r["r_regionkey"], "left").select("s_name", "n_name", "r_name", "s_acctbal")


@query("SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def left_join_performance(spark: SparkSession, d: str) -> DataFrame:
    sums = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return load(spark, d, "customer").select("c_custkey").join(sums, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("SELECT user_id, event_id, ts, (SELECT max(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'view' AND p.ts <= e.ts) AS last_view FROM events e WHERE event_type = 'purchase'")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = load(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", F.desc("is_view")).rowsBetween(Window.unboundedPreceding, 0)
    both = e.where(F.col("event_type").isin("view", "purchase")).withColumn("is_view", (F.col("event_type") == "view").cast("int"))
    seen = both.withColumn("last_view", F.max(F.when(F.col("is_view") == 1, F.col("ts"))).over(w))
    return seen.where("is_view = 0").select("user_id", "event_id", "ts", "last_view")
