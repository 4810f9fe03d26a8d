import numpy as np
from pyspark.sql import functions as F

from textloom.operators import termindex as X

SCHEMA = "document_id string, token_index int, lower string, lemma string, is_alpha boolean, record string, term string"


def test_containers_round_trip_and_union():
    rng = np.random.default_rng(1)
    for n in (0, 1, 4096, 4097, 60_000):
        a = np.unique(rng.integers(0, 1 << 16, n))
        assert (X.unpack(X.pack(a)) == a).all()
        assert X.cardinality(X.pack(a)) == len(a)
    a, b = rng.integers(0, 1 << 16, 5000), rng.integers(0, 1 << 16, 9)
    assert X.cardinality(X.union([X.pack(a), X.pack(b)])) == len(set(a.tolist()) | set(b.tolist()))


def frequencies(df):
    return X.term_frequencies(df, record="document_id", item="token_index", term=X.lemma_of("lemma", "lower"), keep=F.col("is_alpha"))


def test_frequencies_against_brute_force(spark):
    rows = []
    for doc in range(40):
        for i, (low, lemma) in enumerate([("the", "the"), ("café", None), ("café", " Café "), ("x%d" % (doc % 9), ""), ("RUNS", "run\xa0")]):
            rows.append((f"d{doc}", i, low, lemma, True, "clash", "clash"))
    rows += rows[:7]  # repeated rows count once
    rows += [("d0", 90, "none", None, False, "", ""), ("d99", 0, "7", "7", False, "", ""), ("d0", 91, None, None, True, "", ""), ("d1", 92, " ", "", True, "", ""), (None, 3, "lost", "lost", True, "", "")]
    got = {r.term: (r.occurrences, r.records, r.mark) for r in frequencies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["the"] == (40, 40, "common")
    assert got["café"] == (80, 40, "common")
    assert got["run"] == (40, 40, "common")
    assert got["x8"] == (4, 4, None)
    assert set(got) == {"the", "café", "run", *(f"x{i}" for i in range(9))}


def test_empty_and_all_null_tables(spark):
    assert frequencies(spark.createDataFrame([], SCHEMA)).count() == 0
    assert frequencies(spark.createDataFrame([(None, None, None, None, None, None, None)], SCHEMA)).count() == 0


def test_rare_terms(spark):
    rows = [("a", 0, "one", "one", True, "", ""), ("b", 0, "two", "two", True, "", ""), ("c", 0, "two", "two", True, "", ""), ("d", 0, "q", "q", True, "", ""), ("e", 0, "q", "q", True, "", ""), ("f", 0, "q", "q", True, "", "")]
    got = {r.term: r.mark for r in frequencies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"one": "rare", "two": "rare", "q": "common"}
