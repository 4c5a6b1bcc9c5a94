"""The queries over the smallest tables: DuckDB's rows where SQL can express them, the promised columns everywhere."""

from __future__ import annotations

import duckdb
import pytest

from tidemark.llm import queries as Q

pytest.importorskip("public_tokenizers")

COLUMNS = {
    "op2_media_columns": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op3_best_fit_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op4_minhash_near_dedup": "doc_id n_shingles component_id kept",
    "op6_source_mixing": "doc_id size source_size target taken",
    "op8_threshold_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op9_language_id": "doc_id held_out lang_pred score",
    "op10_token_files": "doc_id start n_tokens ids_crc32",
}
KINDS = {
    "bigint": "doc_id n_bytes payload_bytes tail_crc32 media_bytes start length ids_crc32 sequence_id offset n_shingles component_id size source_size taken n_chars n_tokens",
    "int": "piece",
    "double": "target near_edited near_next score",
    "boolean": "kept held_out",
    "string": "payload_sha256 media_sha256 feature edited_sha256 fingerprint edited_fingerprint lang_pred",
}
KIND = {c: k for k, cs in KINDS.items() for c in cs.split()}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_rows_are_those_of_duckdb(spark, data_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir}/{t}.parquet'")
    want = con.sql(Q.oracle_sql()[name]).df()
    got = Q.queries()[name](spark, data_dir).toPandas()
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[sorted(df)].itertuples(index=False))
    assert sorted(got) == sorted(want)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, data_dir, name):
    out = Q.queries()[name](spark, data_dir)
    assert {c: KIND[c] for c in COLUMNS[name].split()}.items() <= dict(out.dtypes).items()
    n = spark.read.parquet(f"{data_dir}/documents.parquet").count()
    assert out.select("doc_id").distinct().count() == n


def test_all_thirteen_are_there():
    assert [sum(name.startswith(f"op{n}_") for name in Q.queries()) for n in range(1, 14)] == [1] * 13
