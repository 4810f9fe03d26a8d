"""Frequency of every distinct term: vertical layout of record-id bitmaps and counters.

Records get dense numbers inside hash buckets, so that a term's records are a few
compressed containers (16-bit positions: a sorted array, or a bitmap where that is
smaller) beside an occurrence counter.  Containers of one term and bucket are merged
by union; document frequency is the sum of the cardinalities.  The only shuffle of
token rows is the one by bucket; what leaves a bucket is one row per term in it, so a
term that holds a tenth (or a third) of all rows costs one container per bucket.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTAINER = 1 << 16
ARRAY_LIMIT = 4096  # beyond this many positions a bitmap is the smaller form
MIN_BUCKETS = 64
BUCKET_RECORDS = 1 << 15


def pack(positions: np.ndarray) -> bytes:
    """Sorted distinct 16-bit positions as a container."""
    positions = np.unique(np.asarray(positions, dtype=np.int64)).astype(np.uint16)
    if len(positions) <= ARRAY_LIMIT:
        return b"A" + positions.astype("<u2").tobytes()
    bits = np.zeros(CONTAINER, dtype=np.uint8)
    bits[positions] = 1
    return b"B" + np.packbits(bits, bitorder="little").tobytes()


def unpack(container: bytes) -> np.ndarray:
    if container[:1] == b"A":
        return np.frombuffer(container, dtype="<u2", offset=1)
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, dtype=np.uint8, offset=1), bitorder="little")).astype(np.uint16)


def union(containers: list[bytes]) -> bytes:
    if len(containers) == 1:
        return containers[0]
    return pack(np.concatenate([unpack(c) for c in containers]))


def cardinality(container: bytes) -> int:
    if container[:1] == b"A":
        return (len(container) - 1) // 2
    return int(np.bitwise_count(np.frombuffer(container, dtype=np.uint8, offset=1)).sum())


def _pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame(
            {
                "term": [unicodedata.normalize("NFC", x) for x in b["raw"]],
                "container": b["container"],
                "bits": [pack(p) for p in b["positions"]],
                "occurrences": b["occurrences"],
            }
        )


def _union(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        bits = [union(list(x)) for x in b["bits"]]
        yield pd.DataFrame({"term": b["term"], "container": b["container"], "bits": bits, "records": [cardinality(x) for x in bits], "occurrences": b["occurrences"]})


def trimmed(column) -> F.Column:
    """Lower case without outer white space (Unicode white space too)."""
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def lemma_of(lemma: str, lower: str) -> F.Column:
    """The lemma, or the lower-case form where the lemma is null or blank; null where both are."""
    a, b = trimmed(F.col(lemma)), trimmed(F.col(lower))
    return F.when(a.isNotNull() & (a != ""), a).when(b != "", b)


def term_bitmaps(df: DataFrame, *, record: str, item: str, term: F.Column, n_records: int) -> DataFrame:
    """``term, container, bits, records, occurrences``: the vertical index of ``term``.

    ``(record, item)`` names an occurrence; repeated rows of one count once (ties of differing
    terms take the smaller).  Rows with a null record or term are left out; a null item is an item
    of its own.  Terms that agree in Unicode form NFC are one.
    """
    buckets = max(MIN_BUCKETS, math.ceil(n_records / BUCKET_RECORDS))
    rows = df.select(
        F.pmod(F.xxhash64(F.col(record)), F.lit(buckets)).alias("bucket"),
        F.col(record).alias("record"),
        F.col(item).alias("item"),
        term.alias("raw"),
    ).filter("record is not null and raw is not null")
    rows = rows.repartition("bucket")
    rows = rows.groupBy("bucket", "record", "item").agg(F.min("raw").alias("raw"))
    pairs = rows.groupBy("bucket", "record", "raw").agg(F.count("*").alias("n"))
    pairs = pairs.withColumn("at", F.dense_rank().over(Window.partitionBy("bucket").orderBy("record")) - 1)
    # A bucket with more than 65,536 records goes on in further containers of its own.
    split = pairs.select("bucket", "raw", "n", F.concat_ws(".", "bucket", F.shiftright("at", 16).cast("string")).alias("container"), F.col("at").bitwiseAND(CONTAINER - 1).alias("pos"))
    lists = split.groupBy("bucket", "container", "raw").agg(F.collect_list("pos").alias("positions"), F.sum("n").alias("occurrences"))
    packed = lists.select("raw", "container", "positions", "occurrences").mapInPandas(_pack, "term string, container string, bits binary, occurrences long")
    merged = packed.groupBy("term", "container").agg(F.collect_list("bits").alias("bits"), F.sum("occurrences").alias("occurrences"))
    return merged.mapInPandas(_union, "term string, container string, bits binary, records long, occurrences long")


def term_frequencies(df: DataFrame, *, record: str, item: str, term: F.Column, keep: F.Column, rare_below: int = 3, common_above: float = 0.40) -> DataFrame:
    """``term, occurrences, records, mark`` for every distinct term.

    ``mark`` is ``rare`` below ``rare_below`` records, ``common`` in more than ``common_above`` of all
    records that ``df`` holds (also those without a kept row), else null.  An empty table gives no rows.
    """
    n_records = df.select(record).filter(F.col(record).isNotNull()).distinct().count()  # one number
    index = term_bitmaps(df.filter(keep), record=record, item=item, term=term, n_records=n_records)
    totals = index.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.lit(common_above * n_records), "common")
    return totals.select("term", "occurrences", "records", mark.alias("mark"))
