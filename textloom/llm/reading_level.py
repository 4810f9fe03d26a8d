"""Reading level: regularised ordinal regression on features of the main text.

Proportional-odds model: P(band <= j) = sigmoid(cut_j - w.x), with increasing cuts and an L2
penalty on w.  Features: lexical diversity, word rarity, connectives, a proxy of clause
depth, and lengths.  Word rarity comes from the counts of all words of all texts, kept in a
hash table of fixed size (its collected size doesn't grow with the data).

The scores are calibrated to the graded texts: each of them is scored by a model fitted without
its fold, and the slope and the cut points are then fitted anew on these scores alone, so they
fit texts that the weights haven't seen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import cut_lineage

MIN_WORDS = 60
MAX_LABELS = 20_000  # label rows the model is fitted on (expected number)
BUCKETS = 1 << 16  # counters of words; on a larger vocabulary rare words share them, so take more
FOLDS = 3  # parts that the calibration scores in turn
PENALTY = 1e-3
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.!?…]+(?:[\"”’»')\]]+)?(?:\s+|$)")
# English connectives and subordinators.
CONNECTIVES = frozenset("although because whereas however therefore moreover furthermore nevertheless despite while since unless though thus hence consequently otherwise instead rather insofar notwithstanding until before after also then so but and or".split())
SUBORDINATORS = frozenset("that which who whom whose where when because although whereas if while since unless though until insofar whether as having".split())
FEATURES = ["word_length", "long_words", "very_long_words", "sentence_length", "log_words", "diversity", "rarity", "rare_words", "connectives", "subordinators", "commas", "short_words", "log_sentence_length"]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(text: str, rarity: dict[str, float] | Callable[[str], float]) -> tuple[int, list[float]]:
    """Number of words and the features of a text."""
    words = words_of(text)
    n = len(words)
    if not n:
        return 0, [0.0] * len(FEATURES)
    lengths = np.array([len(w) for w in words])
    sentences = max(1, len(SENTENCE.findall(text.replace("\n", " "))))
    counts = Counter(words)
    bits = np.array([rarity(w) for w in counts])
    times = np.array(list(counts.values()))
    return n, [
        float(lengths.mean()),
        float((lengths >= 7).mean()),
        float((lengths >= 11).mean()),
        n / sentences,
        float(np.log(n)),
        len(counts) / float(np.sqrt(2 * n)),
        float((bits * times).sum() / n),
        float(times[bits > 13].sum() / n),
        100.0 * sum(c for w, c in counts.items() if w in CONNECTIVES) / n,
        sum(c for w, c in counts.items() if w in SUBORDINATORS) / sentences,
        text.count(",") / sentences,
        float((lengths <= 4).mean()),
        float(np.log(n / sentences)),
    ]


def _word_counts(buckets: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(words_of(text))
            for w, c in seen.items():
                counts[crc32(w.encode()) % buckets] += c
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])

    return run


def word_table(texts: DataFrame, text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of all words of all texts by hash bucket: an array of ``buckets`` numbers."""
    rows = texts.select(text).mapInArrow(_word_counts(buckets), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most ``buckets`` rows
    table = np.zeros(buckets, dtype=np.int64)
    for r in rows:
        table[r["bucket"]] = r["n"]
    return table


def _features(table: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.log2(max(1, int(table.sum()))) - np.log2(np.maximum(table, 1))
        known: dict[str, float] = {}

        def rarity(w: str) -> float:
            x = known.get(w)
            if x is None:
                if len(known) > 500_000:
                    known.clear()
                x = known[w] = float(bits[crc32(w.encode()) % len(bits)])
            return x

        for batch in batches:
            out = [features(t, rarity) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in out], pa.int32()), pa.array([x for _, x in out], pa.list_(pa.float64()))], names=["id", "n_words", "x"])

    return run


@dataclass
class OrdinalModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray
    bands: list[int]

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = ((x - self.mean) / self.scale) @ self.weights
        below = 1 / (1 + np.exp(-(self.cuts[None, :] - score[:, None])))
        p = np.diff(np.c_[np.zeros(len(x)), below, np.ones(len(x))], axis=1)
        return np.array(self.bands)[p.argmax(axis=1)]


def fit_ordinal(x: np.ndarray, y: np.ndarray, *, penalty: float = PENALTY, steps: int = 1500, rate: float = 0.05) -> OrdinalModel:
    """Penalised maximum likelihood by Adam; deterministic."""
    bands = sorted(set(y.tolist()))
    k = len(bands)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z, t = (x - mean) / scale, np.searchsorted(bands, y)
    if k < 2:
        return OrdinalModel(mean, scale, np.zeros(x.shape[1]), np.empty(0), bands)
    share = np.cumsum(np.bincount(t, minlength=k))[:-1] / len(t)
    first = np.log(share / (1 - share))
    # cuts are the first one and positive steps, so that they stay in order
    theta = np.r_[np.zeros(x.shape[1]), first[0], np.log(np.maximum(np.diff(first), 1e-2))]
    m, v, d = np.zeros_like(theta), np.zeros_like(theta), x.shape[1]
    sigmoid = lambda a: 1 / (1 + np.exp(-np.clip(a, -40, 40)))
    for step in range(1, steps + 1):
        w, gaps = theta[:d], np.exp(theta[d + 1 :])
        cuts = theta[d] + np.r_[0, np.cumsum(gaps)]
        s = z @ w
        high = np.where(t < k - 1, sigmoid(cuts[np.minimum(t, k - 2)] - s), 1.0)
        low = np.where(t > 0, sigmoid(cuts[np.maximum(t - 1, 0)] - s), 0.0)
        p = np.maximum(high - low, 1e-9)
        gh, gl = high * (1 - high) / p, low * (1 - low) / p
        gs = gh - gl  # d loss / d score
        gc = np.zeros(k - 1)
        np.add.at(gc, np.minimum(t, k - 2), np.where(t < k - 1, -gh, 0.0))
        np.add.at(gc, np.maximum(t - 1, 0), np.where(t > 0, gl, 0.0))
        tail = np.cumsum(gc[::-1])[::-1]
        g = np.r_[z.T @ gs / len(t) + 2 * penalty * w, tail[0] / len(t), tail[1:] * gaps / len(t)]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    cuts = theta[d] + np.r_[0, np.cumsum(np.exp(theta[d + 1 :]))]
    return OrdinalModel(mean, scale, theta[:d], cuts, bands)


def calibrated(x: np.ndarray, y: np.ndarray, *, folds: int = FOLDS, penalty: float = PENALTY) -> OrdinalModel:
    """The model of all rows, its slope and cuts fitted on scores that come from the other folds."""
    model = fit_ordinal(x, y, penalty=penalty)
    if len(model.bands) < 2:
        return model
    fold, scores = np.arange(len(y)) % folds, np.zeros(len(y))
    for f in range(folds):
        inside = fold != f
        if len(set(y[inside].tolist())) < len(model.bands):
            return model  # too few labels to leave some out
        part = fit_ordinal(x[inside], y[inside], penalty=penalty, steps=500)
        # Folds differ in scale: their scores are moved onto that of the whole model.
        own, whole = ((x[inside] - m.mean) / m.scale @ m.weights for m in (part, model))
        slope, shift = np.polyfit(own, whole, 1)
        scores[fold == f] = slope * ((x[fold == f] - part.mean) / part.scale @ part.weights) + shift
    line = fit_ordinal(scores[:, None], y, penalty=penalty)
    a = line.weights[0] / line.scale[0]
    if a <= 0:
        return model
    return OrdinalModel(model.mean, model.scale, model.weights * a, line.cuts + a * line.mean[0], model.bands)


def text_features(texts: DataFrame, *, record: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """``id, n_words, x`` of every text; null texts count as empty."""
    slim = texts.select(F.col(record).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    table = word_table(slim, "text", buckets)
    return slim.mapInArrow(_features(table), "id string, n_words int, x array<double>")


def labelled_features(found: DataFrame, labels: DataFrame, *, record: str, band: str, max_labels: int = MAX_LABELS) -> tuple[np.ndarray, np.ndarray]:
    """Features and bands of label rows, all or about ``max_labels`` of them chosen by hash."""
    rows = labels.select(F.col(record).cast("string").alias("id"), F.col(band).cast("int").alias("band")).filter("id is not null and band is not null")
    n = rows.count()
    if n > max_labels:
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * max_labels / n))
    got = found.filter(F.col("n_words") >= MIN_WORDS).join(rows, "id").select("id", "x", "band").orderBy("id", "band").collect()  # bounded by max_labels
    return np.array([r["x"] for r in got], dtype=float).reshape(len(got), len(FEATURES)), np.array([r["band"] for r in got], dtype=int)


def reading_levels(texts: DataFrame, labels: DataFrame, *, record: str, text: str, label_record: str = "document_id", band: str = "band", min_words: int = MIN_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """``id, n_words, score, band`` of each text with at least ``min_words`` words.

    The score and the cuts are plain expressions.  Without labelled texts there are no rows.
    """
    found = cut_lineage(text_features(texts, record=record, text=text, buckets=buckets))
    x, y = labelled_features(found, labels, record=label_record, band=band)
    long_enough = found.filter(F.col("n_words") >= min_words)
    if not len(y):
        return long_enough.select("id", "n_words", F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("band")).limit(0)
    model = calibrated(x, y)
    score = F.lit(float(-(model.mean / model.scale) @ model.weights))
    for i, w in enumerate(model.weights / model.scale):
        score = score + F.col("x")[i] * F.lit(float(w))
    scored = long_enough.select("id", "n_words", score.alias("score"))
    below = [F.lit(0.0)] + [1 / (1 + F.exp(F.col("score") - F.lit(float(c)))) for c in model.cuts] + [F.lit(1.0)]
    chances = F.array(*[F.struct((b - a).alias("p"), F.lit(-k).alias("k")) for a, b, k in zip(below, below[1:], model.bands)])
    return scored.select("id", "n_words", "score", (-F.array_max(chances)["k"]).alias("band"))
