"""Language of each document and line: rank-order n-gram profiles, out-of-place distance.

A language's profile is its most frequent three-letter n-grams (word ends included) in rank order.  A line's own n-grams are ranked the same way, and its distance to
a language is the sum of how far each n-gram is out of place, with a fixed penalty for one
that the profile lacks.  N-grams in no profile cost every language the same and are left
out of the ranking.  The arithmetic runs over whole Arrow batches in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ISO 639 codes and English names of the languages.
LANGUAGES = {
    "en": ["en", "eng", "english"],
    "fr": ["fr", "fra", "fre", "french"],
    "de": ["de", "deu", "ger", "german"],
    "es": ["es", "spa", "spanish"],
    "it": ["it", "ita", "italian"],
    "pt": ["pt", "por", "portuguese"],
    "nl": ["nl", "nld", "dut", "dutch"],
}
ALIASES = {alias: code for code, aliases in LANGUAGES.items() for alias in aliases}

PROFILE_SIZE = 1500
PROFILE_ROWS = 400  # labelled documents per language that a profile is fitted on (expected number)
CHUNK = 256  # lines measured at once
BITS = 6  # of a letter's code
GRAMS = 1 << 3 * BITS
END = 255  # code of a line's end
FAR = 0.80  # share of the greatest distance beyond which a line has no words of a language
DOUBT = 0.12  # relative margin below which the other lines of the document are asked
SHORT_LETTERS = 40

# Markup, entities, control sequences and words with digits are no words of a language.
NO_WORDS = re.compile(r"<[^<>]{0,200}>|&#?\w{1,8};|\[[A-Z_]+\]|\x1b\[[0-9;]*[A-Za-z]|\b\w*\d\w*\b|(?:https?://|www\.)\S+|\S+@\S+")
WORD = re.compile(r"[^\W\d_]{2,}")


def _alphabet() -> np.ndarray:
    """Code of each UTF-16 unit: 0 for what isn't a letter, 1..62 for Latin letters, 63 for others below U+0250."""
    table = np.zeros(1 << 16, dtype=np.uint8)
    codes: dict[str, int] = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz", 1)}
    other = 63
    for point in range(0x250):
        c = chr(point).lower()
        if not c.isalpha() or len(c) > 1:
            continue
        if c not in codes and point >= 0xC0 and len(codes) < other - 1:
            codes[c] = len(codes) + 1
        table[point] = codes.get(c, other)
    table[10] = END
    return table


ALPHABET = _alphabet()


def encode_lines(lines: list[str]) -> np.ndarray:
    """Letter codes of the lines, each run of other signs one 0, each line ended by ``END``."""
    text = "\n".join(lines).lower() + "\n"
    codes = ALPHABET[np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16)]
    space = codes == 0
    return codes[np.r_[True, ~(space[1:] & space[:-1])]]


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams (middle one a letter; a 0 is a word's end), the line of each, and letters per line."""
    end = codes == END
    line = np.cumsum(end, dtype=np.int32)  # of the place after
    x = np.where(end, 0, codes).astype(np.int32)
    at = np.flatnonzero(x[1:-1] > 0)
    gram = (x[at] << 2 * BITS) | (x[at + 1] << BITS) | x[at + 2]
    return gram, line[at + 1], np.bincount(line[1:-1][x[1:-1] > 0], minlength=int(line[-1]))


@dataclass
class Profiles:
    languages: list[str]
    feature: np.ndarray  # gram -> feature or -1
    rank: np.ndarray  # feature x language: rank, or PROFILE_SIZE where the profile lacks it

    @property
    def n_features(self) -> int:
        return self.rank.shape[0]


def fit_profiles(texts: Iterable[tuple[str, str]], size: int = PROFILE_SIZE) -> Profiles:
    """Profiles of (language, text) samples; ties in frequency go by gram."""
    samples: dict[str, list[str]] = {}
    for language, text in texts:
        samples.setdefault(language, []).append(text)
    languages, tops = sorted(samples), []
    for language in languages:
        count = np.bincount(grams(np.r_[np.uint8(0), encode_lines("\n".join(samples[language]).split("\n"))])[0], minlength=GRAMS)
        top = np.argsort(-count, kind="stable")[:size]
        tops.append(top[count[top] > 0])
    features = np.unique(np.concatenate(tops)) if tops else np.empty(0, dtype=np.int64)
    feature = np.full(GRAMS, -1, dtype=np.int32)
    feature[features] = np.arange(len(features))
    rank = np.full((len(features), len(languages)), size, dtype=np.int16)
    for i, top in enumerate(tops):
        rank[feature[top], i] = np.arange(len(top))
    return Profiles(languages, feature, rank)


def distances(lines: list[str], profiles: Profiles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Out-of-place distance per line and language (0 to 1), letters per line, ranked n-grams per line."""
    n, m, size = len(lines), profiles.n_features, PROFILE_SIZE
    out, letters, used = np.ones((n, len(profiles.languages))), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for at in range(0, n, CHUNK):
        k = len(lines[at : at + CHUNK])
        gram, line, many_letters = grams(np.r_[np.uint8(0), encode_lines(lines[at : at + CHUNK])])
        letters[at : at + k] = many_letters[:k]
        f = profiles.feature[gram]
        known = f >= 0
        key = line[known] * m + f[known]
        if not len(key):
            continue
        key.sort()
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[new, len(key)])
        row = key[new] // m
        # rank within the line: by falling count, ties by gram
        order = (row.astype(np.int64) << 32) | ((0xFFFF - np.minimum(count, 0xFFFF)) << 16) | (key[new] - row * m)
        order.sort()
        row, f = order >> 32, order & 0xFFFF
        start = np.searchsorted(row, np.arange(k + 1))
        place = (np.minimum(np.arange(len(row)) - start[row], size)).astype(np.int16)
        rank = profiles.rank[f]
        off = np.abs(rank - place[:, None])
        off[rank >= size] = size
        many = np.diff(start)
        filled = np.flatnonzero(many)
        total = np.add.reduceat(off, start[:-1][filled], axis=0, dtype=np.int64)
        out[at + filled] = total / (many[filled] * size)[:, None]
        used[at : at + k] = many
    return out, letters, used


def has_words(line: str) -> bool:
    """Whether a line has words of a language: two words, or one long one, besides markup, numbers and addresses."""
    words = WORD.findall(line)
    if not words:
        return False
    if len(words) >= 4 and "<" not in line and "&" not in line and "[" not in line:
        return True
    words = WORD.findall(NO_WORDS.sub(" ", line))
    return len(words) >= 2 or (len(words) == 1 and len(words[0]) >= 12)


def label_language(label: F.Column) -> F.Column:
    """Two-letter code that a label names (ISO 639 code with or without a region, or English name), else null."""
    base = F.regexp_extract(F.lower(F.regexp_replace(label, r"(?U)\s+", "")), r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    return F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[base]


def classify_document(dist: np.ndarray, letters: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Language index per line (-1: no words of a language) and confidence.

    A line with few letters or a small margin takes the language of its document's clear lines
    where that one is nearly as close.
    """
    n = len(dist)
    if not n:
        return np.empty(0, dtype=np.int64), np.empty(0)
    order = np.argsort(dist, axis=1, kind="stable")
    best, first = order[:, 0], dist[np.arange(n), order[:, 0]]
    second = dist[np.arange(n), order[:, 1]] if dist.shape[1] > 1 else np.ones(n)
    margin = (second - first) / np.maximum(second, 1e-9)
    valid = (used > 0) & (first < FAR)
    clear = valid & (margin >= DOUBT) & (letters >= SHORT_LETTERS)
    best = best.copy()
    if clear.any():
        weight = np.bincount(best[clear], weights=letters[clear], minlength=dist.shape[1])
        present = np.flatnonzero(weight > 0)
        main = int(np.argmax(weight))
        for i in np.flatnonzero(valid & ~clear):
            # among the languages that the document certainly holds, the nearest; others need a clear lead
            near = present[np.argmin(dist[i, present])]
            if dist[i, near] <= first[i] * (1 + 2 * DOUBT) or letters[i] < 12:
                best[i] = near if letters[i] >= 12 else main
    confidence = np.where(valid, np.clip(0.5 + margin * 2, 0.0, 1.0) * np.minimum(1.0, letters / 20), 0.0)
    return np.where(valid, best, -1), confidence


SEGMENT = "key string, label string, line_no int, lang string, confidence double, letters bigint, n_languages int"


def _classify(profiles: Profiles) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = profiles.languages
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys, labels = part.column(0).to_pylist(), part.column(1).to_pylist()
                docs = [(b or b"").decode("utf-8", "replace").split("\n") for b in part.column(2).to_pylist()]
                # only lines with letters are measured
                where = [[i for i, x in enumerate(lines) if has_words(x)] for lines in docs]
                flat = [lines[i] for lines, w in zip(docs, where) for i in w]
                dist, letters, used = distances(flat, profiles) if names else (np.ones((len(flat), 1)),) + (np.zeros(len(flat), dtype=np.int64),) * 2
                rows: list[tuple] = []
                pos = 0
                for key, label, lines, w in zip(keys, labels, docs, where):
                    s = slice(pos, pos + len(w))
                    pos += len(w)
                    lang, conf = classify_document(dist[s], letters[s], used[s])
                    sizes = np.array([len(lines[i]) for i in w], dtype=np.int64)
                    ok = lang >= 0
                    if not ok.any():
                        continue
                    weight = np.bincount(lang[ok], weights=sizes[ok], minlength=len(names))
                    main, kinds = int(np.argmax(weight)), int((weight > 0).sum())
                    rows.append((key, label, 0, names[main], float(np.average(conf[ok], weights=np.maximum(sizes[ok], 1)) * weight[main] / weight.sum()), int(letters[s].sum()), kinds))
                    rows.extend((key, label, i + 1, names[x], float(c), int(le), kinds) for i, x, c, le in zip(w, lang, conf, letters[s]) if x >= 0)
                cols = list(zip(*rows)) or [()] * 7
                types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in SEGMENT.split(", ")])

    return run


def sample_profiles(documents: DataFrame, *, record: str, text: str, label: str, rows_per_language: int = PROFILE_ROWS) -> Profiles:
    """Profiles fitted on about ``rows_per_language`` whole labelled texts of each language.

    The rows are those whose hash of the id falls below a threshold that is set by the number of
    labelled rows, so the sample stays as small as the parameter says at any size of the table.
    """
    labelled = documents.select(F.col(record).alias("key"), label_language(F.col(label)).alias("lang"), F.col(text).alias("text")).filter("lang is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # at most one row a language
    if not sizes:
        return fit_profiles([])
    scale = 1 << 20
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(scale, max(1, round(scale * rows_per_language / n))))])
    sample = labelled.filter(F.pmod(F.xxhash64("key"), F.lit(scale)) < share[F.col("lang")])
    texts = sample.filter("text is not null").select("lang", "key", F.col("text").cast("binary").alias("text")).collect()
    return fit_profiles((r["lang"], bytes(r["text"]).decode("utf-8", "replace")) for r in sorted(texts, key=lambda r: (r["lang"], str(r["key"]))))


def language_segments(documents: DataFrame, *, record: str = "doc_id", text: str = "text", label: str = "lang", profiles: Profiles | None = None, rows_per_language: int = PROFILE_ROWS) -> DataFrame:
    """``key, label, line_no, lang, confidence, letters, n_languages``: line 0 for each document, then each line with words.

    ``lang`` of line 0 is the language that most characters of the document's lines are in.  Null,
    empty and blank texts and texts without words of a language have no row.  No shuffle.
    """
    profiles = profiles or sample_profiles(documents, record=record, text=text, label=label, rows_per_language=rows_per_language)
    slim = documents.select(F.col(record).cast("string").alias("key"), F.col(label).alias("label"), F.col(text).cast("binary").alias("text"))
    return slim.mapInArrow(_classify(profiles), SEGMENT)


def language_cases(segments: DataFrame) -> DataFrame:
    """``key, line_no, lang, confidence``: line 0 where the label is missing or wrong, and all lines of mixed documents."""
    named = label_language(F.col("label"))
    wrong = (F.col("line_no") == 0) & (named.isNull() | (named != F.col("lang")))
    return segments.filter(wrong | ((F.col("line_no") > 0) & (F.col("n_languages") > 1))).select("key", "line_no", "lang", "confidence")
