"""TF-IDF near-duplicates against brute force."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from textloom import queries_core, queries_tables  # noqa: F401
from textloom.operators import similarity


def brute(texts, limit):
    def grams(t):
        out = Counter()
        for w in t.lower().split():
            w = f" {w} "
            for n in (4, 5, 6):
                out[w[:n]] += 1
                for i in range(1, len(w) - n + 1):
                    out[w[i : i + n]] += 1
                if len(w) <= n:
                    break
        return out

    counts = {k: grams(t) for k, t in texts.items()}
    tf, df = Counter(), Counter()
    for c in counts.values():
        tf.update(c)
        df.update(c.keys())
    kept = set(sorted(tf, key=lambda g: (-tf[g], g))[:limit])
    vectors = {k: {g: n * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items() if g in kept} for k, c in counts.items()}
    norm = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in vectors.items()}
    pairs = {(a, b): sum(x * vectors[b].get(g, 0) for g, x in vectors[a].items()) / (norm[a] * norm[b]) for a, b in itertools.combinations(sorted(texts), 2) if norm[a] and norm[b]}
    return {p: s for p, s in pairs.items() if s >= 0.92}


@pytest.mark.parametrize("limit", [150, 150_000])
def test_pairs_against_brute_force(spark, limit):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij\u00e9") for _ in range(rng.randrange(1, 9))) for _ in range(150)]
    texts = {}
    for i in range(12):
        base = [rng.choice(words) for _ in range(60)]
        for j in range(5):
            edit = list(base)
            for _ in range(j * 2):
                edit[rng.randrange(60)] = rng.choice(words)
            texts[f"{i:02d}{j}"] = "  ".join(edit)
    texts |= {f"copy{i}": texts["000"].upper() for i in range(8)} | {"empty": "", "null": ""}
    rows = [(k, None if k == "null" else t) for k, t in texts.items()]
    df = spark.createDataFrame([*rows, rows[0], (None, "x")], "id string, text string")
    got = {(r.id_1, r.id_2): r.cosine for r in similarity.near_duplicate_pairs(df, record="id", text="text", max_features=limit).collect()}
    want = brute(texts, limit)
    assert len(want) > 36 and set(got) == set(want) and all(got[p] == pytest.approx(want[p]) for p in want)
    assert similarity.near_duplicate_pairs(df.limit(0), record="id", text="text").count() == 0


def test_query_is_registered(spark, sf):
    rows = queries_core.QUERIES["near_duplicate_pairs"](spark, sf).collect()
    texts = {r.document_id: r.body or "" for r in spark.read.parquet(f"{sf}/articles.parquet").collect()}
    assert {(r.document_id_1, r.document_id_2) for r in rows} == set(brute(texts, 150_000))


def invented(n, words, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 10))) for _ in range(words)]
    return [" ".join(rng.choice(vocabulary) for _ in range(120)) for _ in range(n)]


def test_shuffle_follows_the_texts(spark):
    """Unlike texts of one vocabulary share rare n-grams with one another; that isn't to be written for each two of them."""
    texts = {f"{i:04d}": t for i, t in enumerate(invented(800, 400, 5))}
    texts["9999"] = texts["0000"] + " more"
    df = spark.createDataFrame(list(texts.items()), "id string, text string")

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = written()
    pairs = [(r.id_1, r.id_2) for r in similarity.near_duplicate_pairs(df, record="id", text="text").collect()]
    assert pairs == [("0000", "9999")]
    assert written() - before < 10 * sum(map(len, texts.values()))


class Sent:
    def __init__(self, value):
        self.value = value


def test_counters_go_out_between_texts(monkeypatch):
    texts = ["", *invented(40, 90, 7), "q" * 30]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 9])], names=["text"]) for i in range(0, len(texts), 9)]
    want_n, want_texts = Counter(), Counter()
    for t in texts:
        g = Counter(x for w in t.split() for x in similarity.grams(w))
        want_n.update(g)
        want_texts.update(g.keys())
    for held in (200_000, 50):
        monkeypatch.setattr(similarity, "HELD", held)
        out, n, several = list(similarity._frequencies(iter(batches))), Counter(), Counter()
        for b in out:
            for g, x, y in zip(*(c.to_pylist() for c in b.columns)):
                n[g] += x
                several[g] += y
        assert n == want_n and several == want_texts and (len(out) > 5) == (held == 50)


@pytest.mark.parametrize("known", [32_768, 40])
@pytest.mark.parametrize("sample", [0, 5, 60])
def test_bounds_lose_no_pair(monkeypatch, sample, known):
    """Whatever sample the directions come from, and however few words a task holds, a bound is no less than the cosine."""
    monkeypatch.setattr(similarity, "KNOWN", known)
    texts = invented(60, 150, 9)
    texts += [t.rsplit(" ", k)[0] for k in (1, 5, 20, 60) for t in texts[:15]]
    vectors = similarity._Vectors(vocabulary := sorted({g for t in texts for w in t.split() for g in similarity.grams(w)}), np.ones(len({g for t in texts for w in t.split() for g in similarity.grams(w)})))
    df = Counter(int(f) for t in texts for f in vectors(t)[0])
    idf = np.log((1 + len(texts)) / (1 + np.array([df[i] for i in range(len(vocabulary))]))) + 1
    whole, unit = similarity._basis(texts[:sample], vocabulary, idf)
    assert np.linalg.norm(whole * unit[:, None].astype(float), 2) <= 1
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(len(texts))]), pa.array(texts)], names=["id", "text"])
    t = pa.Table.from_batches(list(similarity._projections(Sent((vocabulary, idf)), Sent((whole, unit)))(iter([batch]))))
    dense = np.zeros((len(texts), len(vocabulary)))
    vectors.idf = idf
    for i, text in enumerate(texts):
        f, x = vectors(text)
        dense[i, f] = x / np.linalg.norm(x)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(dense @ dense.T, 1) >= 0.92))}
    block = np.arange(len(texts)) % 2
    got = set()
    for b1, b2 in ((0, 0), (0, 1), (1, 1)):
        part = t.append_column("block", pa.array(block)).append_column("b1", pa.array([b1] * len(texts))).append_column("b2", pa.array([b2] * len(texts)))
        pairs = similarity._candidates(0.92)(part.filter(pa.array((block == b1) | (block == b2))))
        new = [tuple(sorted((int(a), int(b)))) for a, b in zip(pairs["x"].to_pylist(), pairs["y"].to_pylist())]
        assert len(new) == len(set(new)) and not got & set(new)
        got |= set(new)
    assert len(want) > 30 and want <= got and (sample < 60 or len(got) < 2 * len(want))
