import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from textloom.functions import text, urls
from textloom.sources import readers, sinks
from textloom.streaming import logs

SCHEMA = readers.struct("document_id string, title string")


def lines(path, rows):
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def test_preferred_layer(spark, tmp_path):
    fallback = lines(tmp_path / "a.jsonl", [{"document_id": "1", "title": "t"}])
    assert readers.layered(spark, str(tmp_path / "none"), fallback, SCHEMA).count() == 1
    ready = lines(tmp_path / "b.jsonl", [{"document_id": "1"}, {"document_id": "2"}])
    assert readers.layered(spark, ready, fallback, SCHEMA).count() == 2
    (tmp_path / "empty.jsonl").write_text("")
    with pytest.raises(FileNotFoundError):
        readers.layered(spark, None, str(tmp_path / "empty.jsonl"), SCHEMA)


def test_logs_and_manifests(spark, tmp_path):
    (tmp_path / "m.txt").write_text("first\n\nthird")
    assert [(r.line_no, r.value) for r in readers.numbered_lines(spark, str(tmp_path / "m.txt")).orderBy("line_no").collect()] == [(1, "first"), (3, "third")]
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None)], "k string, at int, v string")
    assert {(r.k, r.v) for r in readers.last_wins(df, key="k", order="at").collect()} == {("a", "y"), ("b", None)}


def test_gzip_csv_is_spread(spark, tmp_path):
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write('document_id,title\n1,"a ""quoted"" one, with comma"\n2,\n')
    df = readers.csv_table(spark, str(tmp_path / "t.csv.gz"), SCHEMA, ["title", "document_id"], partitions=3)
    assert df.rdd.getNumPartitions() == 3 and sorted(map(tuple, df.collect()), key=str) == [('a "quoted" one, with comma', "1"), (None, "2")]


def test_comparators(spark, tmp_path):
    lines(tmp_path / "c.jsonl", [{"body": "b"}, {"body": "", "text": "t"}, {}])
    assert sorted(r.text for r in readers.comparator_texts(spark, str(tmp_path / "c.jsonl")).collect()) == ["", "b", "t"]
    (tmp_path / "c.csv").write_text('id,body\n1,"two\nlines"\n2,\n')
    assert sorted(r.text for r in readers.comparator_texts(spark, str(tmp_path / "c.csv")).collect()) == ["", "two\nlines"]


def test_blobs_against_their_digests(spark, tmp_path):
    (tmp_path / "ok.html").write_bytes(b"one")
    (tmp_path / "bad.html").write_bytes(b"two")
    blobs = readers.binary_files(spark, str(tmp_path), "*.html").select(F.regexp_extract("path", r"([^/]+)\.html$", 1).alias("key"), "content")
    digest = hashlib.sha256(b"one").hexdigest()
    records = spark.createDataFrame([("ok", digest), ("bad", digest), ("gone", digest)], "k string, d string")
    got = {r.key: r.status for r in readers.stored_blob_check(records, blobs, key="k", digest="d").collect()}
    assert got == {"ok": "ok", "bad": "changed", "gone": "missing"}


def test_configuration(tmp_path):
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert readers.config(str(tmp_path / "c.json")) == {"a": 1}


def test_reports_and_bundles(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", None)], "k string, n int")
    sinks.write_bundle(df, str(tmp_path / "js"), name="DATA")
    value = "\n".join(r.value for r in spark.read.text(str(tmp_path / "js")).collect())
    assert value.startswith("window.DATA = [") and json.loads(value[len("window.DATA = ") : -1]) == [{"k": "a"}, {"k": "b", "n": 2}]
    assert json.loads(sinks.report(df.filter("n = 2"))) == {"k": "b", "n": 2} and sinks.report(df.limit(0)) == "{}"
    assert "| x | unreadable |" in sinks.markdown_counts({"x": sinks.row_count(lambda: 1 / 0), "y": sinks.row_count(lambda: df)})
    assert {"python", "pyspark"} <= set(sinks.environment())
    sinks.write_parquet(df, str(tmp_path / "p"), partition_by=["k"])
    sinks.append_json_lines(df, str(tmp_path / "l"))
    sinks.append_json_lines(df, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 and spark.read.json(str(tmp_path / "l")).count() == 4


def test_windows_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in" / "1.json", [{"url": "a", "at": "2024-01-01T10:00:00"}, {"url": "a", "at": "2024-01-01T23:00:00"}, {"url": "b", "at": "2024-01-05T00:00:00"}])
    stream = logs.json_stream(spark, str(tmp_path / "in"), readers.T.StructType.fromDDL("url string, at timestamp"))
    logs.append_to(logs.windowed_counts(stream, when="at", category="url"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.category, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 2)]


def test_small_text_functions(spark):
    row = spark.createDataFrame([("Old hall – The Site", "ab\ncd", "HTTPS://A.example/x/?q=1#f")], "t string, s string, u string")
    got = row.select(text.site_title(F.col("t"), "The Site"), text.snippet(F.col("s"), F.lit(4), 2), urls.plain_url(F.col("u"))).first()
    assert got[0] == "Old hall" and got[1] == "b\\ncd" and got[2] == "https://a.example/x"


def test_terms_are_found_whole(spark):
    row = spark.createDataFrame([("So that, in the Court, courtly law was LAW.",), ("nothing",), (None,)], "s string")
    hits = [r[0] for r in row.select(text.lexicon_hits(F.col("s"), ["court", "law", "so that"])).collect()]
    assert hits == [["court", "law", "so that"], [], []] and row.select(text.lexicon_hits(F.col("s"), [])).first()[0] == []


def test_parse_errors_and_defaults(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"document_id": "1"}\n{bad\n\n[also\n')
    row = readers.parse_errors(readers.json_lines(spark, str(tmp_path / "a.jsonl"), SCHEMA, strict=False).cache()).first()
    assert tuple(row) == (3, 2, ["[also", "{bad"])
    (tmp_path / "c.json").write_text("[1]")
    assert readers.json_or_default(str(tmp_path / "c.json"), {}) == [1] and readers.json_or_default(str(tmp_path / "none"), {}) == {}
