"""Every core query with SQL gives the rows that DuckDB gives."""

import math
import os

import pytest

from textloom import queries_core, queries_extra, queries_panels, queries_tables, queries_text  # noqa: F401

duckdb = pytest.importorskip("duckdb")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def same_rows(spark, sf, queries, sql, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    df = queries[name](spark, sf)
    cur = con.execute(sql[name])
    columns = [c[0] for c in cur.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert [columns[i] for i in order] == sorted(df.columns)
    want = sorted(repr([plain(r[i]) for i in order]) for r in cur.fetchall())
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*sorted(df.columns)).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(queries_core.SQL))
def test_same_rows_as_sql(spark, sf, name):
    same_rows(spark, sf, queries_core.QUERIES, queries_core.SQL, name)


def test_every_frame_is_counted_by_document(spark, sf):
    rows = spark.read.parquet(f"{sf}/frame_candidates.parquet").select("document_id", "sentence_id", "frame").collect()
    kept = {(r.document_id, r.sentence_id, r.frame.strip(" ").lower()) for r in rows if (r.frame or "").strip(" ")}
    got = {(r.document_id, r.frame): r.n_sentences for r in queries_core.QUERIES["frame_counts_by_document_and_frame"](spark, sf).collect()}
    assert {f for _, f in got} == {f for *_, f in kept} and sum(got.values()) == len(kept)


def test_every_pair_of_seeds_is_compared(spark, sf):
    rows = queries_core.QUERIES["kmeans_agreement"](spark, sf).collect()
    assert sorted((r.seed_1, r.seed_2) for r in rows) == [(13, 42), (13, 87), (42, 87)] and all(-1 <= r.ari <= 1 for r in rows)
