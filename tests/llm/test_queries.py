"""Every opN_ query runs over the smallest tables; those with SQL agree with it."""

import duckdb
import pytest

from tessera.llm import queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


COLUMNS = {
    "op1_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op2_chat_formatting": "conv_id bigint, turn bigint, role string, message bigint, reply_to bigint, position bigint, text string",
    "op3_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op4_exact_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op5_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op6_one_bit_search": "query_id bigint, rank int, vec_id bigint, score double",
    "op7_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op8_language_id": "doc_id bigint, lang_id string, accepted boolean",
    "pages_language_id": "page_id bigint, lang_id string, accepted boolean",
    "op9_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op10_jaccard_join": "doc_id bigint, class_id bigint, n_links bigint",
    "op11_conversation_repair": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op12_token_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op13_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "pipeline": "doc_id bigint, n_tokens bigint",
}


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, sf_dir, duck, name):
    df = queries.queries()[name](spark, sf_dir)
    assert [c for c in COLUMNS[name].split(", ") if tuple(c.split(" ")) not in df.dtypes] == []
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got
    if sql := queries.oracle_sql().get(name):
        r = duck.sql(sql)
        at = [r.columns.index(c) for c in columns]
        assert got == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=repr)
