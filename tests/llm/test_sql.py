"""The corpus queries that SQL can express, against DuckDB; the others run whole and keep their contract's columns."""

import os

import pytest

DATA = os.environ.get("TIDEWATCH_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

from tidewatch.llm import queries  # noqa: E402

COLUMNS = {
    "op1_exact_topk": {"query_id", "rank", "vec_id", "score"},
    "op2_html_extraction": {"page_id", "url", "text", "n_chars"},
    "op3_bpe_codec": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op4_simhash_near_dedup": {"doc_id", "fingerprint", "component_id"},
    "op5_best_fit_packing": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op6_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op7_pii_pseudonyms": {"doc_id", "text"},
    "op8_url_verdicts": {"page_id", "host", "path", "rule", "verdict"},
    "op9_revisit_resolution": {"record_id", "resolved_id"},
    "op10_quality_classifier": {"doc_id", "perplexity", "kept"},
    "op11_spelling_variants": {"word", "form", "root", "n", "n_near", "form_n"},
    "op12_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op13_ranked_search": {"item_id", "rank", "doc_id", "score"},
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "benchmark"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    rel = c.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(x) for x in columns]
    assert sorted((tuple(r[x] for x in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert COLUMNS[name] <= set(df.columns)
    assert df.count() > 0
