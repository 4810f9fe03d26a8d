"""Queries of the subpackage: those with SQL against DuckDB, the others for their columns and bounds."""

import pytest

from test_registry import same_rows
from textloom.llm import queries, tokenizer


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, sf, name):
    same_rows(spark, sf, queries.QUERIES, queries.SQL, name)


@pytest.mark.parametrize(
    "name, columns",
    [
        ("p2_found", {"document_id_1", "document_id_2"}),
        ("p3_found", {"document_id", "line_no"}),
        ("p4_found", {"document_id", "band"}),
        ("p5_clean", {"document_id", "body", "paragraphs", "n_removed_lines", "n_removed_paragraphs"}),
        ("p8_ids", {"doc_id", "ids"}),
        ("p9_containers", {"container_id", "doc_id", "part", "first_token", "n_tokens"}),
        ("p10_found", {"doc_id", "line_no", "lang"}),
    ],
)
def test_columns_and_repeats(spark, sf, name, columns):
    if name in ("p8_ids", "p9_containers"):
        import os

        if not os.path.exists(tokenizer.rank_path()):
            pytest.skip("no vocabulary files")
    df = queries.QUERIES[name](spark, sf)
    assert set(df.columns) == columns
    rows = [tuple(str(v) for v in r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    if name == "p8_ids":
        assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
