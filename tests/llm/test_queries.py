"""The registered queries on the smallest tables, and their SQL twins."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from compare import connect, difference  # noqa: E402

from sentika.llm import catalog, oracles  # noqa: E402

SF = "/root/testdata/sf0.001"
KEYS = {
    "op1_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op2_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op3_virtual_slots": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4_circulant_minhash": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op5_blob_ledger": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op6_warc_segments": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op7_toxic_spans": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_hierarchical_mixing": "doc_id bigint, tokens bigint, budget bigint, copies int",
    "op9_kmeans_tree": "query_id bigint, rank int, vec_id bigint, score double",
    "op11_hidden_markov": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op12_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op13_periodic_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op10_suffix_dedup": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
}


@pytest.mark.parametrize("name", sorted(KEYS))
def test_query_has_its_columns_and_rows(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    assert all(kinds[c] == t for c, t in (x.split() for x in KEYS[name].split(", ")))
    if name in oracles.oracle_sql():
        problem = difference(df, connect(SF), oracles.oracle_sql()[name])
        assert problem is None, problem
    else:
        source = {"op9_kmeans_tree": None}.get(name, "documents")
        expected = spark.read.parquet(f"{SF}/{source}.parquet").count() if source else 50
        assert df.count() == expected


def test_every_query_is_covered():
    assert set(KEYS) == set(catalog.QUERIES)
