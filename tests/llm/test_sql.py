"""Queries with SQL against DuckDB over whole tables, and what every query
of this subpackage promises about its columns."""

import duckdb
import pytest

from sigfolio.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "embeddings", "conversations")
COLUMNS = {
    "op1_bpe_roundtrip": [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")],
    "op2_ann": [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")],
    "op3_suffix_dedup": [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")],
    "op7_shard_pack": [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")],
    "op8_simhash": [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")],
    "op9_html_extract": [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")],
    "op10_toxicity": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op11_importance_resample": [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")],
    "op12_token_files": [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")],
    "op13_prefix_trie": [("conv_id", "bigint"), ("depth", "bigint"), ("parent_conv_id", "bigint"), ("n_convs", "bigint"), ("n_children", "bigint"),
                         ("n_leaves", "bigint"), ("saved_tokens", "bigint"), ("ends_sha256", "string")],
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(([r[cols.index(c)] for c in sorted(cols)] for r in cur.fetchall()), key=repr)
    assert sorted(([r[c] for c in sorted(cols)] for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.dtypes[:len(COLUMNS[name])] == COLUMNS[name]
    table = {"op2_ann": "embeddings", "op9_html_extract": "pages"}.get(name, "documents")
    n = spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name != "op13_prefix_trie":  # one row per node: see test_prefix_trie
        assert df.count() == (25 * 20 if name == "op2_ann" else n)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
