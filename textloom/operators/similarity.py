"""Near-duplicate texts by the cosine of their TF-IDF character n-grams, as scikit-learn's char_wb has them."""

from __future__ import annotations

import hashlib
import math
import sys
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import cut_lineage

THRESHOLD = 0.92
SIZES = (4, 5, 6)
MAX_FEATURES = 150_000  # most frequent n-grams that are features; ties go by n-gram
HELD = 200_000  # counters or words that a task holds at once
SAMPLE = 2_000  # texts whose main directions all texts are projected on
DIRECTIONS, COARSE = 384, 128  # how many; the first ones, which all pairs are compared by
KNOWN = 32_768  # projected words that a task holds at once
BLOCKS, BLOCK, BUCKET = 4, 32_768, 2_000  # blocks at least, texts in one at most; texts in a bucket when pairs are verified
SLACK = 1.2e-3  # on bounds, for half precision


def grams(word: str) -> list[str]:
    """n-grams of a word with a space on either side; a word shorter than n counts once."""
    w, out = f" {word} ", []
    for n in SIZES:
        if len(w) <= n:
            out.append(w)
            break
        out += [w[i : i + n] for i in range(len(w) - n + 1)]
    return out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and counts of small arrays, in half the time of ``np.unique`` or less."""
    x = np.sort(x)
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)
    return x[at], np.diff(at, append=len(x))


class _Words(dict):
    """Words that a task has met as numbers, with the numbers of their n-grams one behind the other; cleared between texts beyond a bound."""

    def __init__(self, number: Callable[[str], list[int]], bound: int = HELD) -> None:
        self.number, self.bound = number, bound
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.grams, self.ends = np.empty(1 << 16, np.int32), np.zeros(1 << 12, np.int64)

    def __missing__(self, word: str) -> int:
        k, new = len(self), self.number(word)
        if k + 1 == len(self.ends):
            self.ends = np.append(self.ends, np.zeros_like(self.ends))
        self.ends[k + 1] = end = self.ends[k] + len(new)
        if end > len(self.grams):
            self.grams = np.append(self.grams, np.empty(end, np.int32))
        self.grams[end - len(new) : end] = new
        self[word] = k
        return k

    def numbers(self, each: list[str]) -> np.ndarray:
        if len(self) > self.bound:
            self.clear()
        known = list(map(self.get, each))
        return np.array([self[w] for w in each] if None in known else known, np.int64)

    def features(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n-grams of some words, and how many each has."""
        starts = self.ends[words]
        many = self.ends[words + 1] - starts
        to = np.cumsum(many)
        return self.grams[np.arange(to[-1] if len(to) else 0) + np.repeat(starts - to + many, many)], many


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of n-grams and the number of texts that have them; a text is counted whole before counters go out."""
    number: dict[str, int] = {}
    words = _Words(lambda w: [number.setdefault(g, len(number)) for g in grams(w)], sys.maxsize)  # cleared below
    times, texts, met = np.zeros(0, np.int64), np.zeros(HELD, np.int64), []

    def counted() -> np.ndarray:
        n = np.bincount(np.concatenate(met), minlength=len(words)) if met else np.zeros(len(words), np.int64)
        n[: len(times)] += times
        met.clear()
        return n

    def batch() -> pa.RecordBatch:
        f, many = words.features(np.arange(len(words)))
        n = np.zeros(len(number), np.int64)
        np.add.at(n, f, np.repeat(counted(), many))
        return pa.RecordBatch.from_arrays([pa.array(list(number), pa.string()), pa.array(n), pa.array(texts[: len(number)])], names=["item", "n", "texts"])

    for b in batches:
        for t in b.column(0).to_pylist():
            w = words.numbers(t.lower().split())
            met.append(w)
            f, _ = words.features(_distinct(w)[0])
            if len(number) > len(texts):
                texts = np.append(texts, np.zeros(len(number), np.int64))
            texts[f] += 1  # an n-gram that is there twice counts once
            if max(len(number), len(words)) > HELD:
                yield batch()
                number.clear(), words.clear()
                times, texts = np.zeros(0, np.int64), np.zeros(HELD, np.int64)
        times = counted()
    yield batch()


class _Vectors:
    """Features of a text, sorted, and their weights."""

    def __init__(self, vocabulary: list[str], idf: np.ndarray, bound: int = HELD) -> None:
        number = {g: i for i, g in enumerate(vocabulary)}
        self.words, self.idf, self.total = _Words(lambda w: [i for g in grams(w) if (i := number.get(g)) is not None], bound), idf, np.zeros(len(idf))

    def square(self, f: np.ndarray, n: np.ndarray) -> float:
        """n-grams may be there several times, with a count each."""
        x = n * self.idf[f]
        np.add.at(self.total, f, x)
        square = float(x @ self.total[f])
        self.total[f] = 0
        return square

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        w, n = _distinct(self.words.numbers(text.lower().split()))
        f, many = self.words.features(w)
        np.add.at(self.total, f, np.repeat(n, many) * self.idf[f])
        one, _ = _distinct(f)
        x = self.total[one]
        self.total[one] = 0
        return one, x


def _basis(texts: list[str], vocabulary: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The main directions of some texts as rows of bytes, one for each feature, and the size of a row's unit.

    As a matrix it shortens every vector or leaves its length (its largest singular value is 1 at most), whatever
    the texts are and however it was rounded; on that alone the bounds rest.
    """
    vectors, rows, cols, values = _Vectors(vocabulary, idf), [], [], []
    for t in texts:
        f, x = vectors(t)
        if len(f):
            rows.append(np.full(len(f), len(rows), np.int16)), cols.append(f), values.append((x / math.sqrt(x @ x)).astype(np.float32))
    if not rows:
        return np.zeros((len(vocabulary), 1), np.int8), np.zeros(len(vocabulary), np.float32)
    many, (r, c, v) = len(rows), (np.concatenate(x) for x in (rows, cols, values))
    rows.clear(), cols.clear(), values.clear()  # the driver's memory is small
    order = np.argsort(c, kind="stable")
    r, c, v = r[order], c[order], v[order]
    del order
    starts = range(0, len(vocabulary), 4096)

    def part(start: int) -> np.ndarray:
        a, b = np.searchsorted(c, (start, start + 4096))
        x = np.zeros((min(4096, len(vocabulary) - start), many), np.float32)
        x[c[a:b] - start, r[a:b]] = v[a:b]
        return x

    products = np.zeros((many, many), np.float32)
    for s in starts:
        products += (x := part(s)).T @ x
    size, u = np.linalg.eigh(products)
    kept = np.flatnonzero(size > 1e-3)[::-1][:DIRECTIONS]
    u = (u[:, kept] / np.sqrt(size[kept])).astype(np.float32)
    whole, unit, square = np.zeros((len(vocabulary), len(kept)), np.int8), np.zeros(len(vocabulary), np.float32), np.zeros((len(kept), len(kept)))
    for s in starts:
        x = part(s) @ u
        unit[s : s + 4096] = step = np.maximum(np.abs(x).max(1), 1e-30) / 127
        whole[s : s + 4096] = rounded = np.rint(x / step[:, None])
        rounded *= step[:, None]
        square += rounded.T @ rounded
    return whole, (unit / math.sqrt(max(np.linalg.eigvalsh(square)[-1], 1e-30) * (1 + 1e-4))).astype(np.float32)


def _projections(features: Broadcast, basis: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The unit vector of a text, projected, in half precision; ``class`` is the same for texts of the same words in the same order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (vocabulary, idf), (whole, unit) = features.value, basis.value
        weight, vectors = (unit * idf).astype(np.float32), _Vectors(vocabulary, idf, KNOWN // 2)
        words, projected, done = vectors.words, np.empty((KNOWN, whole.shape[1]), np.float32), 0
        for b in batches:
            rows = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                each = text.lower().split()
                done *= len(words) <= words.bound  # else they are cleared now
                w, n = _distinct(words.numbers(each))
                f, many = words.features(w)
                if not len(f):
                    continue
                for k in range(done, min(len(words), KNOWN)):
                    g = words.grams[words.ends[k] : words.ends[k + 1]]
                    projected[k] = weight[g] @ whole[g].astype(np.float32)
                done = min(len(words), KNOWN)
                held = np.searchsorted(w, KNOWN)
                y = n[:held].astype(np.float32) @ projected.take(w[:held], axis=0)
                times = np.repeat(n, many)
                for k in range(int(many[:held].sum()), len(f), 4096):  # words beyond those held, of a very long text
                    g = f[k : k + 4096]
                    y += (times[k : k + 4096] * weight[g]).astype(np.float32) @ whole[g].astype(np.float32)
                rows.append((key, hashlib.blake2b(" ".join(each).encode("utf-8", "surrogatepass"), digest_size=16).digest(), (y / math.sqrt(vectors.square(f, times))).astype(np.float16).tobytes()))
            cols = list(zip(*rows)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.binary(), pa.binary()))], names=["id", "class", "y"])

    return run


def _candidates(threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Pairs of two blocks, or of one, whose cosine may reach the threshold."""

    def bounded(y: np.ndarray, k: int) -> np.ndarray:
        """Vectors whose products are bounds of the cosines: what is left of a text counts as if it were the same for all."""
        y = y[:, :k].astype(np.float32)
        return np.column_stack([y, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", y, y)) + SLACK)])

    def run(t: pa.Table) -> pa.Table:
        block = t["block"].to_numpy()
        ids = t["id"].combine_chunks()
        y = np.frombuffer(b"".join(t["y"].to_pylist()), np.float16).reshape(t.num_rows, -1)
        left, right = np.flatnonzero(block == t["b1"][0].as_py()), np.flatnonzero(block == t["b2"][0].as_py())
        same, least = t["b1"][0].as_py() == t["b2"][0].as_py(), np.float32(threshold - SLACK)
        coarse, fine = bounded(y, COARSE), bounded(y, y.shape[1])
        l, r = coarse[left], np.ascontiguousarray(coarse[right].T)
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for start in range(0, len(left), 256):
            first = start if same else 0  # the texts before have been compared
            at = np.flatnonzero((l[start : start + 256] @ r[:, first:]).ravel() >= least) if len(right) else np.empty(0, np.int64)
            i, j = np.divmod(at, len(right) - first) if len(at) else (at, at)
            i, j = i + start, j + first
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 65_536):
                a, b = left[i[k : k + 65_536]], right[j[k : k + 65_536]]
                hit = np.einsum("ij,ij->i", fine[a], fine[b]) >= least
                found.append((a[hit], b[hit]))
        a, b = (np.concatenate(x) for x in zip(*found))
        return pa.table({"x": ids.take(pa.array(a)), "y": ids.take(pa.array(b))})

    return run


def _cosines(features: Broadcast) -> Callable[[pa.Table, pa.Table], pa.Table]:
    held: list[_Vectors] = []  # of this task, for all of its groups

    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        vocabulary, idf = features.value
        if not held:
            held.append(_Vectors(vocabulary, idf))
        of = {k: (*(x := held[0](t)), math.sqrt(float(x[1] @ x[1]))) for k, t in zip(texts["id"].to_pylist(), texts["text"].to_pylist())}
        pairs = pairs.sort_by("id_1")
        dense, last, out = np.zeros(len(idf)), None, []
        for a, b in zip(pairs["id_1"].to_pylist(), pairs["id_2"].to_pylist()):
            if a != last:
                if last is not None:
                    dense[of[last][0]] = 0
                f, x, _ = of[last := a]
                dense[f] = x
            f, x, size = of[b]
            out.append(float(dense[f] @ x) / (of[a][2] * size))
        return pa.table({"id_1": pairs["id_1"], "id_2": pairs["id_2"], "cosine": pa.array(out, pa.float64())})

    return run


def near_duplicate_pairs(texts: DataFrame, *, record: str, text: str, threshold: float = THRESHOLD, max_features: int = MAX_FEATURES) -> DataFrame:
    """``id_1, id_2, cosine``: every pair of records at or above ``threshold``, ``id_1 < id_2``.

    No pair is lost: the product of two vectors is that of their projections and, at most, that of the
    lengths of what is left of them, so only pairs below the threshold are dropped.  All pairs of texts are
    compared by the first directions, blocks against blocks, those left by all directions, and what then
    remains is verified on the whole vectors.  Texts that are the same words in the same order are one class, looked up once.
    Repeated rows of a record count once, a null text is an empty one.  The reference looks at six
    neighbours of a text only; its pairs are among these.
    """
    spark = texts.sparkSession
    slim = texts.filter(F.col(record).isNotNull()).select(F.col(record).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    slim = cut_lineage(slim.groupBy("id").agg(F.min("text").alias("text")))
    total = slim.count()
    counted = slim.select("text").mapInArrow(_frequencies, "item string, n bigint, texts bigint").groupBy("item").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    top = counted.orderBy(F.desc("n"), "item").limit(max_features).select("item", "texts").toArrow()
    vocabulary, idf = top["item"].to_pylist(), np.log((1 + total) / (1 + top["texts"].to_numpy())) + 1
    features = spark.sparkContext.broadcast((vocabulary, idf))
    sample = [r["text"] for r in slim.filter(F.col("text").rlike(r"\S")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("text").collect()]
    basis = spark.sparkContext.broadcast(_basis(sample, vocabulary, idf))
    signed = cut_lineage(slim.mapInArrow(_projections(features, basis), "id string, class binary, y binary"))
    basis.destroy()
    members = signed.groupBy("class").agg(F.min("id").alias("rep")).join(signed.select("class", "id"), "class").select("rep", "id")
    reps = signed.join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    n = max(BLOCKS, math.ceil(total / BLOCK))
    placed = reps.select("id", "y", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    placed = placed.select(F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "id", "y").repartition(2 * n * (n + 1), "b1", "b2")
    pairs = placed.groupBy("b1", "b2").applyInArrow(_candidates(threshold), "x string, y string").select(F.least("x", "y").alias("id_1"), F.greatest("x", "y").alias("id_2"))
    buckets = [F.pmod(F.xxhash64(c), F.lit(math.ceil(total / BUCKET) + 15)) for c in ("id_1", "id_2")]
    pairs = cut_lineage(pairs.select(F.least(*buckets).alias("g1"), F.greatest(*buckets).alias("g2"), "id_1", "id_2"))
    wanted = pairs.select("g1", "g2", F.col("id_1").alias("id")).unionByName(pairs.select("g1", "g2", F.col("id_2").alias("id"))).distinct()
    needed = wanted.join(slim, "id").select(F.col("g1").alias("h1"), F.col("g2").alias("h2"), "id", "text")
    links = pairs.groupBy("g1", "g2").cogroup(needed.groupBy("h1", "h2")).applyInArrow(_cosines(features), "id_1 string, id_2 string, cosine double").filter(F.col("cosine") >= threshold)
    links = links.select(F.col("id_1").alias("rep_1"), F.col("id_2").alias("rep_2"), "cosine")
    m1, m2 = members.select(F.col("rep").alias("rep_1"), F.col("id").alias("m1")), members.select(F.col("rep").alias("rep_2"), F.col("id").alias("m2"))
    crossing = links.join(m1, "rep_1").join(m2, "rep_2").select("m1", "m2", "cosine")
    same = m1.join(m2, F.col("rep_1") == F.col("rep_2")).filter("m1 < m2").select("m1", "m2", F.lit(1.0).alias("cosine"))
    return crossing.unionByName(same).select(F.least("m1", "m2").alias("id_1"), F.greatest("m1", "m2").alias("id_2"), "cosine")
