"""Registered corpus queries beside their SQL twins."""

from __future__ import annotations

import duckdb
import pytest

from occgraph.llm import queries
from verify.check import TABLES, compare


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    verdict = compare(con, queries.QUERIES[name](spark, sf), queries.SQL[name])
    assert verdict.startswith("ok"), verdict


COLUMNS = {
    1: "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", 2: "doc_id size source_size target taken",
    3: "doc_id start length ids_crc32 doc_tokens sequence_id offset", 4: "doc_id held_out n_tokens n_known train_tokens base_score score",
    5: "page_id url text n_chars", 6: "doc_id n_bytes n_removed n_spans kept_sha256", 7: "query_id rank vec_id score",
    8: "doc_id fingerprint component_id", 9: "doc_id expected", 10: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    11: "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256", 12: "page_id host path rule verdict", 13: "lang rank phrase a l r n score",
}


@pytest.mark.parametrize("n", list(COLUMNS))
def test_query_has_its_columns(spark, sf, n):
    name = next(q for q in queries.QUERIES if q.startswith(f"op{n}_"))
    assert set(COLUMNS[n].split()) <= set(queries.QUERIES[name](spark, sf).columns)
