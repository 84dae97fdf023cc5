"""The registered queries on the smallest tables: contract columns and types, one row per input row, SQL where there is any."""

import pytest
from oracle_check import compare, connect

from redpencil.llm import queries

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op2_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op3_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op6_hmm_lm": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op7_quality_cotraining": "doc_id bigint, held_out boolean, score double",
    "op8_chat_format": "conv_id bigint, turn bigint, role string, rendered string",
    "op9_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op10_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op11_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12_exact_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op13_source_divergence": "lang string, source string, part string, item string, value bigint, rank int",
}
# Rows are not those of a table.
OWN_ROWS = ("op2_packing", "op12_exact_topk", "op13_source_divergence")


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    types = dict(df.dtypes)
    assert {c: types[c] for c in (p.split()[0] for p in COLUMNS[name].split(", "))} == dict(p.split() for p in COLUMNS[name].split(", "))
    if name in queries.oracle_sql():
        assert compare(df, connect(FOLDER), queries.oracle_sql()[name]) is None
    source = "conversations" if name.startswith("op8") else "documents"
    rows = spark.read.parquet(f"{FOLDER}/{source}.parquet").count()
    assert df.count() == rows or name in OWN_ROWS and df.count() > 0


def test_every_operator_has_one_query():
    assert set(queries.queries()) == set(COLUMNS)
