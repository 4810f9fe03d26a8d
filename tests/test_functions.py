import re

import pytest
from pyspark.sql import functions as F

from textloom.functions import stats, text, urls


def values(spark, column, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_tokens_like_the_pattern_in_python(spark):
    samples = ["It’s a well-known fact", "O'Neil 3rd x2y", "", None, "naïve café Straße", "a_b 9lives --x", "ÅÄÖ l'été"]
    want = [[m.lower().replace("’", "'") for m in re.findall(r"\b[^\W\d_][\w'’-]*\b", s or "")] for s in samples]
    assert values(spark, text.tokens, samples) == want


def test_sentences(spark):
    assert values(spark, text.sentences, ["One. Two!  \"Three?\" four. 5 six", "", None, "no end"]) == [["One.", "Two!", "\"Three?\" four.", "5 six"], [], [], ["no end"]]


def test_syllables(spark):
    assert values(spark, text.syllables, ["table", "make", "the", "rhythm", "eye", "123", "idea"]) == [2, 1, 1, 1, 1, 0, 2]


def test_readability_of_nothing(spark):
    r = values(spark, text.readability, ["", None])
    assert all(x.word_count == 0 and x.flesch_reading_ease_estimate == pytest.approx(206.835) for x in r)


def test_mattr_against_brute_force(spark):
    docs = ["", "a b a", " ".join(f"w{i % 37}" for i in range(51)), " ".join(f"w{i * i % 83}" for i in range(400))]

    def brute(d, w=50):
        t = d.split()
        if not t:
            return 0.0
        if len(t) <= w:
            return len(set(t)) / len(t)
        return sum(len(set(t[i : i + w])) / w for i in range(len(t) - w + 1)) / (len(t) - w + 1)

    assert values(spark, lambda c: text.mattr(F.filter(F.split(c, " "), lambda x: x != "")), docs) == pytest.approx([brute(d) for d in docs])


def test_normalise_is_deterministic_and_redacts(spark):
    raw = "ﬁrst  line\r\nmail a.b@c.example.org\r\n\r\n\r\n second\tblock "
    once = values(spark, text.normalise_text, [raw])
    assert once == ["first line\nmail [EMAIL_REDACTED]\n\nsecond block"]
    assert values(spark, text.normalise_text, once) == once


def test_lexicon_overlaps_and_boundaries(spark):
    col = lambda c: text.lexicon_hits(c, ["history", "history teaches", "on"])
    assert values(spark, col, ["History teaches on", "prehistory only", "ön on"]) == [["history", "history teaches", "on"], [], ["on"]]


def test_footer_cut(spark):
    body = "x" * 400 + " Showing 3 reactions Sign in with"
    r = values(spark, text.footer_cut, [body, "Sign in with " + "y" * 400, "none", None])
    assert [x.status for x in r] == ["footer_removed", "marker_too_early", "no_marker", "no_marker"]
    assert r[0].body == "x" * 400 and r[0].markers == "reaction_section|sign_in_section"


def test_urls(spark):
    got = values(spark, urls.canonical_url, ["HTTPS://Www.Ex.example:443//a//b/?q=1#f", "http://ex.example/", "mailto:x", None])
    assert got == ["https://www.ex.example/a/b", "http://ex.example", "mailto:x", None]
    assert values(spark, urls.asset_url, ["http://x/a.jpg;v=1?w=2#t"]) == ["http://x/a.jpg?w=2"]
    assert values(spark, urls.page_number, ["/l?page=12", "/l"]) == [12, None]
    df = spark.createDataFrame([("http://x/a/b", "../c?d"), (None, "c")], "b string, l string")
    assert [r[0] for r in df.select(urls.resolve_link("b", "l")).collect()] == ["http://x/c?d", None]


def test_statistics(spark):
    df = spark.createDataFrame([(10, 100, 5, 200), (0, 0, 0, 0), (3, 10, 0, 10)], "a int, b int, c int, d int")
    g, r = stats.log_likelihood(*(F.col(x) for x in "abcd")), stats.log_ratio(*(F.col(x) for x in "abcd"))
    out = df.select(g.alias("g"), r.alias("r")).collect()
    assert out[0].g == pytest.approx(2 * (10 * 0.693147181 + 5 * -0.693147181), rel=1e-6)
    assert out[1].g == 0.0 and out[1].r == 0.0 and out[2].g > 0
    tail = spark.range(1).select(stats.chi2_tail(F.lit(3.841459)).alias("p")).first().p
    assert tail == pytest.approx(0.05, abs=1e-6)


def test_benjamini_hochberg(spark):
    ps = [0.01, 0.04, 0.03, 0.04, 0.9]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(ps)], "i int, p double")
    got = [r.q_value_bh for r in stats.benjamini_hochberg(df, "p").orderBy("i").collect()]
    assert got == pytest.approx([0.05, 0.05, 0.05, 0.05, 0.9])
    assert stats.benjamini_hochberg(df.limit(0), "p").count() == 0


def test_adjusted_rand(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "a int, b int")
    assert stats.adjusted_rand(df, "a", "b").first().ari == 1.0


def test_exact_median(spark):
    import random
    import statistics

    rng = random.Random(1)
    for n in (1, 2, 501, 1000):
        v = [rng.choice([rng.gauss(0, 1), 7.0, -1e6]) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
        assert stats.exact_median(df, "v", bins=8, small=20) == statistics.median(v)
    assert stats.exact_median(spark.createDataFrame([], "v double"), "v") is None
