"""Items that appear together: stripes of co-occurring neighbours and log-likelihood ratios.

Stripes: each task keeps, per item, an associative array of the neighbours seen beside it
and hands on one (partial) stripe per item instead of one row per pair and record.  The arrays are
merged by key, (item, slice): a stripe is cut into ``SLICES`` by the hash of the neighbour, so a hot item's
stripe is merged by many tasks, and a task that reads its keys in order holds one slice at a time.  The
diagonal entry of a stripe is the item's own record count, and the stripe of the empty item holds the number of
records, so one pass over the records gives every figure that the statistics need.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import cut_lineage

ENTRIES_IN_MEMORY = 400_000  # neighbours a task holds before it hands its stripes on
SLICES = 16  # parts of a stripe, by the hash of the neighbour
MIN_LLR = 3.84  # chi-square of one degree of freedom at 5 %; eight records at 2.5 times chance give 5.06 at least
STRIPE = "kind string, item string, slice int, neighbours map<string,bigint>"
_STRIPE_SCHEMA = pa.schema([("kind", pa.string()), ("item", pa.string()), ("slice", pa.int32()), ("neighbours", pa.map_(pa.string(), pa.int64()))])


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 5_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 5_000]), _STRIPE_SCHEMA)], schema=_STRIPE_SCHEMA)


def _stripes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], dict[str, int]] = {}
    size = 0

    def emit() -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for (kind, item), stripe in held.items():
            parts: dict[int, list] = {}
            for neighbour, n in stripe.items():
                parts.setdefault(crc32(neighbour.encode()) % SLICES, []).append((neighbour, n))
            rows.extend((kind, item, k, entries) for k, entries in parts.items())
        yield from _batches(rows)
        held.clear()

    for batch in batches:
        for kind, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total = held.setdefault((kind, ""), {})
            total[""] = total.get("", 0) + 1
            items = sorted(items)
            for i, item in enumerate(items):
                stripe = held.get((kind, item))
                if stripe is None:
                    stripe = held[(kind, item)] = {}
                before = len(stripe)
                for neighbour in items[i:]:  # the first is the item itself
                    stripe[neighbour] = stripe.get(neighbour, 0) + 1
                size += len(stripe) - before
                if size > ENTRIES_IN_MEMORY:
                    yield from emit()
                    size = 0
    yield from emit()


def stripes(records: DataFrame) -> DataFrame:
    """Partial stripes of ``records(kind, items)``; ``items`` are distinct in their record."""
    return records.select("kind", "items").mapInArrow(_stripes, STRIPE)


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the arrays of equal keys, which come one after another."""
    key, array, rows = None, {}, []
    for batch in batches:
        for *k, entries in zip(*(c.to_pylist() for c in batch.columns)):
            if k != key:
                if key:
                    rows.append((*key, list(array.items())))
                key, array = k, {}
                if len(rows) >= 5_000:
                    yield from _batches(rows)
                    rows = []
            for neighbour, n in entries:
                array[neighbour] = array.get(neighbour, 0) + n
    if key:
        rows.append((*key, list(array.items())))
    yield from _batches(rows)


def merged(parts: DataFrame) -> DataFrame:
    """``kind, item, slice, neighbours``: the stripes, each slice once."""
    key = ("kind", "item", "slice")
    return parts.repartition(*key).sortWithinPartitions(*key).mapInArrow(_merge, STRIPE)


def item_records(rows: DataFrame, *, kind: str, record: str, item: F.Column) -> DataFrame:
    """``kind, record, items`` of rows that hold one item each; repeated rows count once.

    Null records, null and blank items and ``nan`` are left out; so is a record without an item.
    """
    clean = F.lower(F.regexp_replace(item, r"(?U)^\s+|\s+$", ""))
    slim = rows.select(F.col(record).cast("string").alias("record"), clean.alias("item")).filter("record is not null and item is not null and item not in ('', 'nan')")
    return slim.groupBy("record").agg(F.collect_set("item").alias("items")).select(F.lit(kind).alias("kind"), "record", "items")


def llr(n12, n1, n2, n):
    """Log-likelihood ratio (G2) of the 2x2 table of two items; 0 log 0 is 0."""
    cells = [n12, n1 - n12, n2 - n12, n - n1 - n2 + n12]
    rows, cols = [n1, n - n1], [n2, n - n2]

    def term(k, r, c):
        return F.when(k > 0, k * F.log(k * n / (r * c))).otherwise(F.lit(0.0))

    parts = [term(cells[0], rows[0], cols[0]), term(cells[1], rows[0], cols[1]), term(cells[2], rows[1], cols[0]), term(cells[3], rows[1], cols[1])]
    return 2.0 * (parts[0] + parts[1] + parts[2] + parts[3])


def cooccurrence(records: DataFrame) -> DataFrame:
    """``kind, item_1, item_2, n12, n1, n2, n, lift, llr`` for every pair that shares a record, ``item_1 < item_2``.

    ``records(kind, record, items)``: one row per record with its distinct items.  An empty table
    gives no rows; records of one item count in n and n1 only.
    """
    whole = merged(stripes(records)).select("kind", F.col("item").alias("item_1"), F.explode("neighbours").alias("item_2", "n"))
    counts = cut_lineage(whole)  # read four times below, made once
    single = counts.filter("item_1 = item_2 and item_1 <> ''").select("kind", F.col("item_1").alias("item"), F.col("n").alias("m"))
    total = counts.filter("item_1 = ''").select("kind", F.col("n").alias("total"))
    pairs = counts.filter("item_1 < item_2 and item_1 <> ''").select("kind", "item_1", "item_2", F.col("n").alias("n12"))
    pairs = pairs.join(single.select("kind", F.col("item").alias("item_1"), F.col("m").alias("n1")), ["kind", "item_1"])
    pairs = pairs.join(single.select("kind", F.col("item").alias("item_2"), F.col("m").alias("n2")), ["kind", "item_2"])
    pairs = pairs.join(total, "kind")
    a, b, c, n = (F.col(x).cast("double") for x in ("n12", "n1", "n2", "total"))
    return pairs.select("kind", "item_1", "item_2", "n12", "n1", "n2", F.col("total").alias("n"), (a * n / (b * c)).alias("lift"), llr(a, b, c, n).alias("llr"))


def significant(pairs: DataFrame, *, min_records: int = 8, min_lift: float = 2.5, min_llr: float = MIN_LLR) -> DataFrame:
    """Pairs in at least ``min_records`` records, ``min_lift`` times as often as by chance, with a significant ratio.

    With k records at r times chance the ratio is at least 2 k (ln r - 1 + 1 / r), so under the default counts the default
    ``min_llr`` takes nothing away; it tells where fewer records or a lower lift are asked for.
    """
    lifted = F.col("n12") * F.col("n") >= F.lit(min_lift) * F.col("n1") * F.col("n2")
    return pairs.filter((F.col("n12") >= min_records) & lifted & (F.col("llr") >= min_llr))
