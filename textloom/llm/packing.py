"""Filling containers of fixed capacity: bounded-space online best-fit.

Each task keeps a fixed number of open containers.  A bitset keyed by free space finds the
fullest one that still takes an item in one shift and mask; where none does, a container is
opened, and at the limit the fullest closes first.  What a task leaves open is handed to
fewer tasks, level by level, until one is left; these remainders are at most
``open_bins`` containers per task, whatever the size of the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.runtime import cut_lineage

OPEN_BINS = 64
FULL_ENOUGH = 0.995  # an open container filled so far is closed with its task
FAN_IN = 16
HELD = 10_000  # items of size 0 that wait for the first container to close


class BestFit:
    """Open containers by free space; ``add`` yields the containers it had to close."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.limit, self.count = capacity, open_bins, 0
        self.bits, self.by_free = 0, {}  # free space -> containers, each a list of items

    def _take(self, free: int) -> list:
        stack = self.by_free[free]
        bin_ = stack.pop()
        if not stack:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_

    def _put(self, free: int, bin_: list) -> None:
        self.by_free.setdefault(free, []).append(bin_)
        self.bits |= 1 << free
        self.count += 1

    def add(self, size: int, item: tuple) -> list[list]:
        closed = []
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.count >= self.limit:
                closed.append(self.fullest())
            free, bin_ = self.capacity, []
        bin_.append(item)
        if free == size:
            closed.append(bin_)
        else:
            self._put(free - size, bin_)
        return closed

    def fullest(self) -> list:
        """Closes the fullest container; an empty one where none is open."""
        return self._take((self.bits & -self.bits).bit_length() - 1) if self.bits else []

    def rest(self) -> Iterator[tuple[int, list]]:
        for free in sorted(self.by_free):
            for bin_ in self.by_free[free]:
                yield free, bin_


SCHEMA = "container_id bigint, item string, part int, first_token bigint, n_tokens bigint, is_open boolean"


def _fill(capacity: int, open_bins: int, level: int, last: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = ((level << 22) + (context.partitionId() if context else 0)) << 36
        packer, rows = BestFit(capacity, open_bins), []
        closed: int | None = None  # the container that closed last; items without size go straight into it
        sizeless: list[tuple] = []

        def close(bin_: list, is_open: bool) -> None:
            nonlocal number, closed
            if not is_open:
                closed, bin_ = number, [*bin_, *sizeless]
                sizeless.clear()
            rows.extend((number, *item, is_open) for item in bin_)
            number += 1

        def table() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in SCHEMA.split(", ")])
            rows.clear()
            return out

        def items() -> Iterator[tuple[int, tuple]]:
            for batch in batches:
                for item, part, first, n in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    k = 0
                    while n > capacity:
                        yield capacity, (item, part + k, first, capacity)
                        k, first, n = k + 1, first + capacity, n - capacity
                    yield n, (item, part + k, first, n)

        # The remainders of other tasks are few: they go in by falling size.
        for n, item in items() if level == 0 else sorted(items(), key=lambda x: (-x[0], x[1])):
            if n:
                for bin_ in packer.add(n, item):
                    close(bin_, False)
            elif closed is not None:
                rows.append((closed, *item, False))
            else:
                sizeless.append(item)
                if len(sizeless) >= HELD:
                    close(packer.fullest(), False)
            if len(rows) >= 20_000:
                yield table()
        for free, bin_ in packer.rest():
            close(bin_, not last and free > (1 - FULL_ENOUGH) * capacity)
        if sizeless:  # at most HELD: with the other remainders, or in a container of their own at the end
            close(list(sizeless), not last)
        yield table()

    return run


def fill_containers(items: DataFrame, *, item: str, size: str, capacity: int = 2048, open_bins: int = OPEN_BINS) -> DataFrame:
    """``container_id, item, part, first_token, n_tokens``: each item once, in containers of ``capacity``.

    Only an item larger than the capacity is split, into full parts and one remainder, numbered
    from 0.  An item of size 0 (a null or empty text) takes no space and goes into the container that closed last, so
    any number of them needs no memory; a null size counts as 0.  Repeated rows are items of their own.  An empty table gives no rows.
    """
    names = ["item", "part", "first_token", "n_tokens"]
    rows = items.select(F.col(item).cast("string").alias("item"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("first_token"), F.coalesce(F.col(size).cast("bigint"), F.lit(0).cast("bigint")).alias("n_tokens"))
    done: list[DataFrame] = []
    level = 0
    rows = cut_lineage(rows)  # the sizes are read once; container numbers then never change
    while True:
        tasks = rows.rdd.getNumPartitions()
        last = tasks <= 1
        filled = cut_lineage(rows.select(*names).mapInArrow(_fill(capacity, open_bins, level, last), SCHEMA))
        done.append(filled.filter("not is_open"))
        if last:
            break
        left = filled.filter("is_open").select(*names)
        rows = cut_lineage(left.coalesce(max(1, -(-tasks // FAN_IN))))
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("is_open")
