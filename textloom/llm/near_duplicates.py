"""Near-duplicate texts: circulant MinHash, banding, exact Jaccard verification.

A text is the set of its sequences of consecutive words.  One permutation (sigma) scatters
the hashed sequences over a ring of 2^32 places, a second one (pi), shifted by k places, gives
coordinate k of the signature: two permutations stand for all coordinates.  Both are bijections
made of odd multiplications and shifts, so no table is held.  Texts with the same set are one class with
one representative; only representatives are banded.  Pairs that share a band are verified on their
whole sets, so nothing that is found is an estimate.

A band with more than ``BLOCK`` texts is cut into blocks, and each pair of blocks is a task's work of its own
(``hot_links``): a pair counts in the first hot band that its texts share, so it is verified once however many
bands they share, and the sizes of all intersections of two blocks come from one product of 0-1 matrices; no pair is
written before it has been verified.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.lines import join_spread
from textloom.runtime import cut_lineage

WIDTH = 3  # words in a sequence
THRESHOLD = 0.7
BANDS, ROWS = 28, 4  # a pair at 0.7 is missed with a probability of 0.0005, one at 0.8 of 4e-7
BLOCK = 1_000  # texts of one band, or copies of one class, that one task compares with as many others
AT_ONCE = 4_096  # sequences whose coordinates are computed at once
SIGMA, PI = (0x9E3779B1, 0x85EBCA6B), (0xC2B2AE35, 0x27D4EB2F)  # odd factors of the two permutations
WORD = re.compile(r"[^\W_]+")


def permuted(places: np.ndarray, factors: tuple[int, int]) -> np.ndarray:
    """A permutation of the ring of 2^32 places; changes ``places``."""
    places *= np.uint32(factors[0])
    places ^= places >> np.uint32(16)
    places *= np.uint32(factors[1])
    return places


class Shingler:
    """Hashed sets of word sequences; a task keeps the hashes of words it has seen, up to a bound."""

    def __init__(self, width: int) -> None:
        self.width, self.words = width, {}

    def __call__(self, text: str) -> np.ndarray:
        words, known = WORD.findall(text.lower()), self.words
        if len(words) < self.width:
            return np.empty(0, dtype=np.int64)
        if len(known) > 500_000:
            known.clear()
        h = np.empty(len(words), dtype=np.uint64)
        for i, w in enumerate(words):
            x = known.get(w)
            if x is None:
                x = known[w] = xxhash.xxh3_64_intdigest(w)
            h[i] = x
        n = len(words) - self.width + 1
        out = np.zeros(n, dtype=np.uint64)
        for i in range(self.width):
            out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out).view(np.int64)


def signature(shingles: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of a non-empty set of 64-bit hashes."""
    at = permuted((shingles.view(np.uint64) >> np.uint64(32)).astype(np.uint32), SIGMA)
    shifts = np.arange(1, coordinates + 1, dtype=np.uint32)[:, None]
    out = np.full(coordinates, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(at), AT_ONCE):
        np.minimum(out, permuted(at[None, i : i + AT_ONCE] - shifts, PI).min(axis=1), out=out)
    return out


def bands(sig: np.ndarray) -> list[int]:
    """One 64-bit key per band; the band's number is part of it."""
    rows = sig.reshape(-1, ROWS).astype("<u4")
    return [xxhash.xxh3_64_intdigest(r.tobytes(), seed=i) - (1 << 63) for i, r in enumerate(rows)]


def _signatures(width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingler(width)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = sets(text)
                if len(s):
                    rows.append((key, xxhash.xxh3_128_hexdigest(s.tobytes()), len(s), bands(signature(s))))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())))], names=["id", "class", "size", "bands"])

    return run


def _sets(width: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingler(width)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sets(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], names=["id", "shingles"])

    return run


COLUMNS = 8_192  # sequences of a block that are multiplied at once


def _aligned(column: pa.ChunkedArray, missing: int) -> np.ndarray:
    """Hot bands of texts by place, ``missing`` where a band isn't hot."""
    return np.array([[missing if b is None else b for b in row] for row in column.to_pylist()], dtype=np.int64)


def _first_shared(key: tuple, left: pa.Table, right: pa.Table, threshold: float) -> np.ndarray:
    """Which pairs of two blocks belong to this band: no earlier hot band in common, sizes within the threshold."""
    at, x, y = (k.as_py() for k in key[1:])
    a, b = _aligned(left.column("shared"), -1), _aligned(right.column("shared"), -2)
    mine = np.ones((len(a), len(b)), dtype=bool)
    for q in range(at):
        mine &= a[:, q][:, None] != b[:, q][None, :]
    s1, s2 = (np.array(t.column("size").to_pylist(), dtype=np.int64) for t in (left, right))
    mine &= np.minimum(s1[:, None], s2[None, :]) >= threshold * np.maximum(s1[:, None], s2[None, :])
    if x == y:  # one block with itself: each pair once
        i1, i2 = (np.array(t.column("id").to_pylist(), dtype=object) for t in (left, right))
        mine &= i1[:, None] < i2[None, :]
    return mine


_GROUP = [("band", pa.int64()), ("at", pa.int32()), ("x", pa.int32()), ("y", pa.int32())]
NEEDED = "band bigint, at int, x int, y int, id string, is_left boolean"


def _needed(threshold: float) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The texts of a pair of blocks that have a pair to be verified there."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids: list[str] = []
        sides: list[bool] = []
        if len(left) and len(right):
            mine = _first_shared(key, left, right, threshold)
            for table, any_, is_left in ((left, mine.any(axis=1), True), (right, mine.any(axis=0), False)):
                found = [i for i, k in zip(table.column("id").to_pylist(), any_) if k]
                ids += found
                sides += [is_left] * len(found)
        columns = [pa.array([k.as_py()] * len(ids), t) for k, (_, t) in zip(key, _GROUP)]
        return pa.table([*columns, pa.array(ids, pa.string()), pa.array(sides, pa.bool_())], names=[*(n for n, _ in _GROUP), "id", "is_left"])

    return run


def _common_sizes(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), dtype=np.float32)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        hit = common[at] == values
        return at[hit], owners[hit]

    if len(common):
        both = [places(x) for x in (left, right)]
        for lo in range(0, len(common), COLUMNS):
            parts = []
            for (at, owners), sets in zip(both, (left, right)):
                m = np.zeros((len(sets), min(COLUMNS, len(common) - lo)), dtype=np.float32)
                here = (at >= lo) & (at < lo + COLUMNS)
                m[owners[here], at[here] - lo] = 1.0
                parts.append(m)
            out += parts[0] @ parts[1].T
    return out


def _verified(threshold: float) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        first, second, values = [], [], np.empty(0)
        if len(left) and len(right):
            mine = _first_shared(key, left, right, threshold)
            sets = [[np.array(v, dtype=np.int64) for v in t.column("shingles").to_pylist()] for t in (left, right)]
            common = _common_sizes(*sets).astype(np.float64)
            sizes = [np.array([len(v) for v in x], dtype=np.float64) for x in sets]
            jaccard = common / (sizes[0][:, None] + sizes[1][None, :] - common)
            i, j = np.nonzero(mine & (jaccard >= threshold))
            values = jaccard[i, j]
            ids = [np.array(t.column("id").to_pylist(), dtype=object) for t in (left, right)]
            one, two = ids[0][i], ids[1][j]
            swap = one > two
            first, second = np.where(swap, two, one), np.where(swap, one, two)
        return pa.table([pa.array(list(first), pa.string()), pa.array(list(second), pa.string()), pa.array(values, pa.float64())], names=["id_1", "id_2", "jaccard"])

    return run


def shared_hot_bands(hot: DataFrame) -> DataFrame:
    """``id, shared``: the hot bands of each text by their place, null for a band that isn't hot."""
    by_place = F.map_from_entries(F.collect_list(F.struct("at", "band")))
    return hot.groupBy("id").agg(by_place.alias("m")).select("id", F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.col("m")[i]).alias("shared"))


def hot_links(hot: DataFrame, shared: DataFrame, sets: Callable[[DataFrame], DataFrame], *, threshold: float, block: int) -> DataFrame:
    """``id_1, id_2, jaccard`` of all pairs of ``hot(band, at, id, size, m)`` with a band in common; ``sets`` gives ``id, shingles`` of the wanted ids."""
    blocks = F.ceil(F.col("m") / block).cast("int")
    placed = cut_lineage(hot.join(shared, "id").withColumn("b", F.pmod(F.xxhash64("id"), blocks).cast("int")))
    group = ["band", "at", "x", "y"]
    left = placed.select("band", "at", F.col("b").alias("x"), F.explode(F.sequence("b", blocks - 1)).alias("y"), "id", "size", "shared")
    right = placed.select("band", "at", F.explode(F.sequence(F.lit(0), "b")).alias("x"), F.col("b").alias("y"), "id", "size", "shared")
    own = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731 - columns that are told from those of the other side
    right = own(right)
    needed = cut_lineage(left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_needed(threshold), NEEDED))
    texts = cut_lineage(sets(needed.select("id").distinct()).join(placed.select("id", "size", "shared").dropDuplicates(["id"]), "id"))
    sides = [needed.filter(F.col("is_left") == is_left).drop("is_left").join(texts, "id") for is_left in (True, False)]
    return sides[0].groupBy(*group).cogroup(own(sides[1]).groupBy(*group)).applyInArrow(_verified(threshold), "id_1 string, id_2 string, jaccard double")


def pairs_within(rows: DataFrame, key: str, *, block: int = BLOCK) -> DataFrame:
    """``id_1, id_2, s1, s2`` of all pairs of ``rows(key, id, size)`` with the same key, ``id_1 < id_2``.

    A group of up to ``block`` rows is joined with itself; a larger one is cut into blocks, and each pair
    of blocks is a task's work of its own.
    """
    counted = rows.select(key, "id", "size").withColumn("m", F.count("*").over(Window.partitionBy(key)))
    counted = cut_lineage(counted.filter("m > 1"))
    few, many = counted.filter(F.col("m") <= block), counted.filter(F.col("m") > block)
    left, right = (few.select(key, F.col("id").alias(f"id_{i}"), F.col("size").alias(f"s{i}")) for i in (1, 2))
    small = left.join(right, key).filter("id_1 < id_2").drop(key)
    blocks = F.ceil(F.col("m") / block).cast("int")
    placed = many.withColumn("b", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    ids = lambda i: (F.col("id").alias(f"id_{i}"), F.col("size").alias(f"s{i}"))
    left = placed.select(key, F.col("b").alias("x"), F.explode(F.sequence("b", blocks - 1)).alias("y"), *ids(1))
    right = placed.select(key, F.explode(F.sequence(F.lit(0), "b")).alias("x"), F.col("b").alias("y"), *ids(2))
    crossed = left.join(right, [key, "x", "y"]).filter("x < y or id_1 < id_2")
    swap = F.col("id_1") > F.col("id_2")
    pick = lambda a, b, name: F.when(swap, F.col(b)).otherwise(F.col(a)).alias(name)
    large = crossed.select(pick("id_1", "id_2", "id_1"), pick("s1", "s2", "s1"), pick("id_2", "id_1", "id_2"), pick("s2", "s1", "s2"))
    return small.unionByName(large)


def near_duplicates(texts: DataFrame, *, record: str, text: str, width: int = WIDTH, threshold: float = THRESHOLD, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members, links): ``id, representative, copies`` of every text with a sequence, and
    ``id_1, id_2, jaccard`` of every pair of representatives at or above ``threshold``, ``id_1 < id_2``.

    Null and empty texts and those with fewer words than a sequence are in no class.  Repeated
    rows of a record count once.  The hashes are of 64 bits, a class is told by 128.
    """
    slim = texts.select(F.col(record).cast("string").alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    signed = cut_lineage(slim.mapInArrow(_signatures(width), "id string, class string, size int, bands array<bigint>"))
    ids = signed.select("id", "class").distinct()
    classes = ids.groupBy("class").agg(F.min("id").alias("representative"), F.count("*").alias("copies"))
    members = join_spread(ids, classes, ["class"], weight="copies", total=signed.count(), value="c").select("id", "c.representative", "c.copies", "class")
    members = cut_lineage(members)
    first = members.filter("id = representative").select("id", "class")
    reps = signed.join(first, ["id", "class"], "left_semi").dropDuplicates(["id", "class"])
    counted = reps.select("id", "size", F.posexplode("bands").alias("at", "band")).withColumn("m", F.count("*").over(Window.partitionBy("band")))
    counted = cut_lineage(counted.filter("m > 1"))  # texts alone in a band drop out
    hot = counted.filter(F.col("m") > block)
    is_hot = not hot.isEmpty()
    # A link needs sizes within the threshold of one another.
    near = F.least("s1", "s2") >= threshold * F.greatest("s1", "s2")
    few = counted.filter(F.col("m") <= block)
    left, right = (few.select("band", F.col("id").alias(f"id_{i}"), F.col("size").alias(f"s{i}")) for i in (1, 2))
    pairs = left.join(right, "band").filter(near & (F.col("id_1") < F.col("id_2"))).select("id_1", "id_2").distinct()
    if is_hot:  # pairs with a hot band in common are verified there
        shared = cut_lineage(shared_hot_bands(hot))
        of = [shared.select(F.col("id").alias(f"id_{i}"), F.array_compact("shared").alias(f"h{i}")) for i in (1, 2)]
        pairs = pairs.join(of[0], "id_1", "left").join(of[1], "id_2", "left").filter(~F.coalesce(F.arrays_overlap("h1", "h2"), F.lit(False))).select("id_1", "id_2")
    pairs = cut_lineage(pairs)

    def sets(wanted: DataFrame) -> DataFrame:
        return slim.dropDuplicates(["id"]).join(wanted, "id", "left_semi").mapInArrow(_sets(width), "id string, shingles array<bigint>")

    found = cut_lineage(sets(pairs.select(F.col("id_1").alias("id")).unionByName(pairs.select(F.col("id_2").alias("id"))).distinct()))  # read for both sides
    both = pairs.join(found.select(F.col("id").alias("id_1"), F.col("shingles").alias("x")), "id_1").join(found.select(F.col("id").alias("id_2"), F.col("shingles").alias("y")), "id_2")
    common = F.size(F.array_intersect("x", "y"))
    jaccard = common / (F.size("x") + F.size("y") - common)
    links = both.select("id_1", "id_2", jaccard.alias("jaccard")).filter(F.col("jaccard") >= threshold)
    if is_hot:
        links = links.unionByName(hot_links(hot, shared, sets, threshold=threshold, block=block))
    return members.drop("class"), links


def linked_records(members: DataFrame, links: DataFrame, *, copies: str = "pairs", block: int = BLOCK) -> DataFrame:
    """``id_1, id_2``: links between records, ``id_1 < id_2``.

    With ``copies="pairs"`` every pair of records whose texts are linked or copies of one another, whatever
    the size of a class.  With ``"star"`` the representative stands for its copies: links run between
    representatives, and each copy is linked to its representative.  No pair comes twice.
    """
    if copies == "star":
        star = members.filter(F.col("id") != F.col("representative")).select(F.col("representative").alias("id_1"), F.col("id").alias("id_2"))
        return links.select("id_1", "id_2").unionByName(star)
    if copies != "pairs":
        raise ValueError(copies)
    several = members.filter("copies > 1").select("representative", "id")
    within = pairs_within(several.withColumn("size", F.lit(0)), "representative", block=block).select("id_1", "id_2")
    # Links of two texts without copies stand as they are.
    of = [several.select(F.col("representative").alias(f"id_{i}"), F.col("id").alias(f"m{i}")) for i in (1, 2)]
    crossing = links.select("id_1", "id_2").join(of[0], "id_1", "left").join(of[1], "id_2", "left").select(F.coalesce("m1", "id_1").alias("m1"), F.coalesce("m2", "id_2").alias("m2"))
    return within.unionByName(crossing.select(F.least("m1", "m2").alias("id_1"), F.greatest("m1", "m2").alias("id_2")))


def classes_with_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """``id, class_id, copies, n_links``: one row per record, with the links of its class's representative."""
    ends = links.select(F.col("id_1").alias("representative")).unionByName(links.select(F.col("id_2").alias("representative")))
    degree = ends.groupBy("representative").agg(F.count("*").alias("n_links"))
    return members.join(degree, "representative", "left").select("id", F.col("representative").alias("class_id"), "copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
