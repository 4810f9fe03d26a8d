import base64
import random

import pytest
from pyspark.sql import functions as F

from textloom import runtime
from textloom.functions import stats, text, urls
from textloom.operators import panels, topics


def test_numbers_are_places_in_the_order(spark):
    values = random.Random(1).sample(range(100_000), 2000)
    df = spark.createDataFrame([(v, "clash") for v in values], "v long, _p string").repartition(7)
    got = {r.v: r.row_number for r in panels.numbered(df, [F.col("v")]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values), 1)}
    assert panels.numbered(df.limit(0), [F.col("v")]).count() == 0


def test_false_discovery_rates_against_brute_force(spark):
    rng = random.Random(2)
    ps = [round(rng.random() ** 3, 3) for _ in range(500)] + [None, 0.0, 1.0, 1.0]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double").repartition(9)
    got = {r.i: r.q_value_bh for r in stats.benjamini_hochberg(df, "p").collect()}
    known = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    m, low, want = len(known), 1.0, {}
    for rank in range(m, 0, -1):
        low = min(low, known[rank - 1][0] * m / rank)
        want[known[rank - 1][1]] = low
    # equal p-values have one rate: that of the last of them
    for p, i in known:
        want[i] = min(w for (q, j) in known if q == p for w in [want[j]]) if p != 0 else want[i]
    assert len(got) == len(ps) and got[500] is None
    assert all(got[i] == pytest.approx(want[i]) for i in want)
    assert stats.benjamini_hochberg(df.limit(0), "p").count() == 0


def test_strings_of_nested_records(spark):
    df = spark.createDataFrame([("k", "t", [("a", 1), (None, 2)], ["x", None]), ("l", None, None, [])], "id string, title string, parts array<struct<name:string,n:int>>, tags array<string>")
    got = sorted((r.id, r.path, r.value) for r in panels.string_fields(df, key="id").collect())
    assert got == [("k", "parts[].name", "a"), ("k", "tags[]", "x"), ("k", "title", "t")]


def test_defaults_and_clean_values(spark):
    df = spark.createDataFrame([("7", None, float("nan")), ("x", "NaN ", 1.5), (None, "b", None)], "n string, s string, v double")
    got = [tuple(r) for r in panels.with_defaults(df, {"n": ("int", -1), "s": ("string", ""), "absent": ("boolean", False)}).collect()]
    assert got == [(7, "", False), (-1, "NaN ", False), (-1, "b", False)]
    assert [tuple(r) for r in panels.cleaned(df).collect()] == [("7", None, None), ("x", None, 1.5), (None, "b", None)]


def test_record_hash_does_not_depend_on_the_order_of_columns(spark):
    df = spark.createDataFrame([("a", None), ("b", 2)], "x string, y int")
    one, two = ([r[0] for r in d.select(panels.record_hash(d)).collect()] for d in (df, df.select("y", "x")))
    assert one == two and len(set(one)) == 2 and panels.id_column(df) is None and panels.id_column(df.withColumn("doc_id", F.lit(1))) == "doc_id"
    assert panels.enough(df, 2) and not panels.enough(df, 3)


def test_stored_blobs_under_either_address(spark):
    key = lambda u: spark.range(1).select(F.substring(F.sha2(F.lit(u), 256), 1, 20)).first()[0]
    stored = spark.createDataFrame([(key("http://a/1"),), (key("http://a/2b"),), (None,)], "h string")
    df = spark.createDataFrame([("1", "http://a/1", None), ("2", "http://a/2", "http://a/2b"), ("3", "http://a/3", "http://a/3"), ("4", None, None)], "id string, request_url string, final_url string")
    assert {r.id for r in panels.without_stored_blob(df, stored, key="id", urls=["request_url", "final_url"], stored_key="h").collect()} == {"3", "4"}


def test_listed_order_puts_the_rest_behind(spark):
    df = spark.createDataFrame([("a", "u2"), ("b", "u9"), ("c", "u1"), ("d", None), ("c", "u1")], "id string, url string")
    listing = spark.createDataFrame([("u1", 4), ("u1", 7), ("u2", 0), (None, 1)], "u string, p int")
    got = {r.id: r.place for r in panels.listed_order(df, listing, url=F.col("url"), listed_url="u", position="p", key="id").collect()}
    assert got == {"a": 0, "c": 4, "b": 5, "d": 6}


def test_reextraction(spark):
    stored = spark.createDataFrame([("1", "one  two"), ("2", "one"), ("3", "x"), ("4", None)], "document_id string, body string")
    new = spark.createDataFrame([("1", "one two", None), ("2", "one more", None), ("3", None, "no title")], "document_id string, body string, error string")
    got = {r.document_id: (r.status, r.stored_words, r.extracted_words) for r in panels.reextraction_difference(stored, new).collect()}
    assert got == {"1": ("match", 2, 2), "2": ("different", 1, 2), "3": ("error", 1, 0), "4": ("missing", 0, 0)}


def test_counters_of_a_run(spark):
    df, seen = panels.observed(spark.range(10), "run", odd=F.count_if(F.col("id") % 2 == 1))
    assert df.count() == 10 and seen.get == {"rows": 10, "odd": 5}


def test_scaling(spark):
    df = spark.createDataFrame([(2.0,), (6.0,), (3.0,), (None,)], "v double")
    assert [r.scaled for r in panels.min_max_scaled(df, "v").collect()] == [0.0, 1.0, 0.25, None]
    assert [r.scaled for r in panels.min_max_scaled(df.filter("v = 2"), "v").collect()] == [0.0]


@pytest.mark.parametrize("mime, url, want", [("image/jpeg", "http://a/x.png", ".jpg"), (None, "http://a/x.JPEG?y=1", ".jpeg"), ("image/bmp", "http://a/x", ".bmp"), ("text/html", "http://a/x.html", ".img"), (None, None, ".img")])
def test_image_extensions(spark, mime, url, want):
    row = spark.createDataFrame([(mime, url)], "m string, u string")
    assert row.select(urls.image_extension(F.col("m"), F.col("u"))).first()[0] == want


@pytest.mark.parametrize("url, width, height, want", [("http://a/Gravatar/1", 900, 900, True), ("http://a/p.jpg", 80, 80, True), ("http://a/p.jpg", 80, 81, False), ("http://a/p.jpg", 0, 10, False), (None, None, None, False)])
def test_decorative_images(spark, url, width, height, want):
    row = spark.createDataFrame([(url, width, height)], "u string, w int, h int")
    assert row.select(urls.decorative_image(F.col("u"), F.col("w"), F.col("h"))).first()[0] is want


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return None

    with pytest.raises(RuntimeError):
        runtime.ensure_checkpoint_dir(Session())
    Context.master = "local[2]"
    Context.setCheckpointDir = lambda self, path: None
    assert runtime.ensure_checkpoint_dir(Session())


def test_remaining_column_functions(spark):
    row = spark.createDataFrame([("https://www.a.example/news/story?x=1", "YES")], "u string, t string")
    got = row.select(urls.allowed_article(F.col("u"), hosts=["www.a.example", "a.example"], excluded_paths=["/about"], excluded_prefixes=["/tag/"]), urls.url_hash(F.lit("abc")), text.truthy(F.col("t"))).first()
    assert got[0] is True and got[1] == "ba7816bf8f01cfea4141" and got[2] is True



def test_plausible_base64(spark):
    noise, words = bytes(range(256)) * 2, b"plain words that were only written down in another way " * 4
    rows = [(base64.b64encode(noise).decode(), True), (base64.b64encode(words).decode(), False), (base64.b64encode(b"%PDF" + words).decode(), True), (base64.b64encode(noise).decode()[:124], False), ("A" * 130, False), ("", False), (None, False)]
    df = spark.createDataFrame(rows, "b string, want boolean")
    assert [(bool(r[0]), r[1]) for r in df.select(panels.plausible_base64(F.col("b")), "want").collect()] == [(w, w) for _, w in rows]


def test_url_facts(spark):
    rows = [("HTTP://u@A.example:80/x/Setup.EXE).",), ("https://a.example/x.html?y=.exe",), ("data:text/plain,x",), (None,), ("https://a.example",)]
    got = [tuple(r) for r in panels.url_facts(spark.createDataFrame(rows, "u string"), url="u").collect()]
    assert got == [
        ("HTTP://u@A.example:80/x/Setup.EXE", "http", "a.example", ".exe", True),
        ("https://a.example/x.html?y=.exe", "https", "a.example", ".html", False),
        ("data:text/plain,x", "data", None, "", False),
        ("https://a.example", "https", "a.example", "", False),
    ]


def test_document_filter(spark):
    schema = "id string, title string, author string, tags array<string>, year int, date_flag string, image_count int, word_count int"
    df = spark.createDataFrame([("d1", "Old Hall", "A", ["x", "y"], 2020, "ok", 1, 50), ("d2", None, None, None, None, "missing", 0, 0), ("d3", "Hall", "B", [], 2021, "future", 2, 500)], schema)
    ids = lambda **k: {r.id for r in panels.document_filter(df, **k).collect()}
    assert ids() == {"d1", "d2", "d3"} and ids(text=" HALL ") == {"d1", "d3"} and ids(text="d2") == {"d2"} and ids(tag="y") == {"d1"} and ids(year=2021) == {"d3"}
    assert ids(date_flag="issue") == {"d2", "d3"} and ids(date_flag="ok") == {"d1"} and ids(has_image=False) == {"d2"} and ids(has_image=True, words=(0, 100)) == {"d1"} and ids(author="B") == {"d3"}


def test_review_filter_and_rejects(spark):
    df = spark.createDataFrame([("1", "d", "A hall", "x", "valid", True, None), ("2", "e", None, "y", "unreviewed", None, None)], "id string, document_id string, sentence string, category string, status string, quotation_flag boolean, reported_speech_flag boolean")
    titles = spark.createDataFrame([("e", "Quay")], "document_id string, title string")
    ids = lambda **k: {r.id for r in panels.review_filter(df, titles, **k).collect()}
    assert ids(text="quay") == {"2"} and ids(quoted_only=True) == {"1"} and ids(category="y", status="unreviewed") == {"2"} and ids() == {"1", "2"}
    kept, rejected = panels.split_by(df, F.col("quotation_flag"), F.lit("no quotation"))
    assert [r.id for r in kept.collect()] == ["1"] and [(r.id, r.reject_reason) for r in rejected.collect()] == [("2", "no quotation")]


def test_shown_text(spark):
    row = spark.createDataFrame([("public_order", "<a & 'b'>", None)], "n string, h string, z string")
    assert tuple(row.select(panels.title_case(F.col("n")), panels.html_escaped(F.col("h")), panels.html_escaped(F.col("z"))).first()) == ("Public Order", "&lt;a &amp; &#39;b&#39;&gt;", "")


def test_examples_of_a_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4990, "hot").otherwise("rare").alias("g"), (5000 - F.col("id")).alias("v"))
    got = sorted((r.g, r.r, r.v) for r in panels.examples_per_group(df, group="g", order=[F.col("v")], n=2).collect())
    assert got == [("hot", 1, 11), ("hot", 2, 12), ("rare", 1, 1), ("rare", 2, 2)]


def test_intermediate_tables_go_with_their_consumer(spark):
    import os

    with runtime.scratch():
        path = runtime._written[-1][1] if runtime._written else None
        df = runtime.cut_lineage(spark.range(3))
        mine = runtime._written[-1][1]
        local = mine.removeprefix("file:")
        assert mine != path and df.count() == 3 and os.path.isdir(local)
    assert not os.path.isdir(local) and (path is None or runtime._written[-1][1] == path)


def test_topics_tell_two_subjects_apart(spark):
    rng = random.Random(3)
    words = {0: "ferry harbour pier tide sailor anchor".split(), 1: "pupil lesson teacher classroom exam desk".split()}
    rows = [(i, " ".join(rng.choice(words[i % 2]) for _ in range(20))) for i in range(80)] + [(90, None), (91, ""), (92, "the of and")]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("record", F.lit("clash"))
    found = topics.topic_clusters(df, record="id", body="t", k=2)
    got = {r.record: r.topic for r in found.collect()}
    assert set(got) == set(range(80)) and len({got[i] for i in range(0, 80, 2)}) == 1 and got[0] != got[1]
    terms = topics.topic_terms(df, found, record="id", body="t", n=6).collect()
    assert {r.term for r in terms if r.topic == got[0]} == set(words[0]) and {r.n_documents for r in terms} == {40}
    assert topics.topic_clusters(df.limit(20), record="id", body="t").count() == 0


def test_listings_end_at_empty_pages(spark):
    rows = [("a", i, n) for i, n in enumerate([3, 0, 1, 0, 0, 5, 0])] + [("b", 0, 0), ("b", 1, 0), ("b", 2, 4), ("c", 0, 1)]
    df = spark.createDataFrame(rows, "l string, p int, n int")
    got = {(r.l, r.p) for r in panels.pages_until_empty(df, listing="l", page="p", found="n").collect()}
    assert got == {("a", i) for i in range(5)} | {("b", 0), ("b", 1), ("c", 0)}


def test_scores_as_json(spark):
    row = spark.createDataFrame([(["x", None, "y"], [0.5, 0.1, None])], "n array<string>, s array<double>")
    assert row.select(panels.scores_json(F.col("n"), F.col("s"))).first()[0] in ('{"x":0.5,"y":null}', '{"x":0.5}')
    totals = spark.createDataFrame([("frame_x", 9), ("we", 5), ("legitimation_y", 7), ("us", 6)], "marker string, total int")
    assert [r.marker for r in panels.without_prefixes(totals).collect()] == ["us", "we"]
