"""Every query runs on the smallest tables, and gives what DuckDB gives where SQL can express it."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from tidemark.plans import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df)].copy()
    for c in df:
        listed = df[c].map(lambda v: v.tolist() if hasattr(v, "tolist") and not isinstance(v, str | bytes) else v)
        df[c] = [("NULL" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v) else str(v)) for v in listed]
    return df.sort_values(list(df)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data_dir, duck, name):
    got = QUERIES[name](spark, data_dir).toPandas()
    if name in SQL:
        want = duck.sql(SQL[name]).df()
        a, b = _plain(got), _plain(want)
        assert list(a) == list(b)
        assert len(a) == len(b)
        assert not len(a) or a.equals(b)
    assert len(got.columns) > 0


@pytest.mark.parametrize("name", ["combined_scores", "rank_similarity"])
def test_whole_lists_have_no_limit(spark, data_dir, name):
    assert "Limit" not in QUERIES[name](spark, data_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_whole_graph_has_every_edge(spark, data_dir, duck):
    edges = duck.sql(SQL["first_edge_per_pair"].replace("min(type) AS type", "count(*) AS n")).fetchall()
    nodes = {r[0] for r in duck.sql("SELECT s_suppkey FROM supplier UNION ALL SELECT * FROM range(100010, 100310)").fetchall()}
    place = {x: x for x in nodes} | {x: x for a, b, _ in edges for x in (a, b)}
    for _ in place:
        old = dict(place)
        for a, b, _ in edges:
            place[a] = place[b] = min(place[a], place[b])
        if old == place:
            break
    got = QUERIES["graph_statistics"](spark, data_dir).first()
    assert (got.n_nodes, got.n_edges) == (len(nodes), sum(n for _, _, n in edges))
    assert got.components == len(set(place.values()))


def test_centroids_near_zero(spark, tmp_path):
    """Means of less than half a digit, either sign, as SQL rounds them."""
    x = [-2e-6, 2e-6, -0.0, 0.0, -5e-6, 0.25, -0.125] + [0.5] * 57
    rows = spark.createDataFrame([(k, x, k % 2) for k in range(4)], "vec_id long, embedding array<float>, label int")
    rows.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["cluster_centroids"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert _plain(got).equals(_plain(con.sql(SQL["cluster_centroids"]).df()))
