"""Filling containers of fixed capacity by bounded-space online best-fit (problem 7)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block's containers are numbered from its number times this.
CONTAINERS_PER_BLOCK = 1 << 32


class BestFit:
    """Open containers in a bitset keyed by free space: bit f is set while some open container has f units left.

    An item goes into the open container with the least space that holds it, found by the lowest set bit from its size
    on. If there is none, a new container is opened; if then too many are open, the fullest is closed, the lowest set bit.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, at: int) -> int:
        bin_ = self.by_free[at].pop()
        if not self.by_free[at]:
            self.bits &= ~(1 << at)
        self.open -= 1
        return bin_

    def place(self, size: int) -> int:
        """The container of an item of at most the capacity; an item of size 0 joins the fullest open container."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, self.made
            self.made += 1
            if self.open >= self.most and size < free:
                self._take((self.bits & -self.bits).bit_length() - 1)
        if left := free - size:
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_

    def place_whole(self) -> int:
        """A container for a part as large as the capacity."""
        self.made += 1
        return self.made - 1


def packed(items: DataFrame, id_: str, size: str, capacity: int = 512, open_bins: int = 64, items_per_block: int = 20_000, n_items: int | None = None) -> DataFrame:
    """Assign every row of ``items`` to containers: (id, part, start, n_tokens, container).

    Only an item larger than the capacity is split: into parts that fill a container each, and a rest that is packed like
    an item. ``part`` counts from 0, ``start`` is the part's offset in its item. Items of size 0 or null take no space and join
    an open container. ``id_`` should be unique; repeated rows are items of their own. An empty table gives an empty one.

    Items fall into blocks by a hash of their id, in which they come in the order of another hash, so that the result
    depends on neither files nor tasks and a task that runs again gives the same. Only ids and sizes are shuffled. A
    block is a stream: what a task holds is its open containers. A block's last containers stay part-filled, at most
    ``open_bins`` of the several thousand that it has. A task takes blocks one after the other, so their number may exceed that of
    the tasks, which is the session's number of shuffle partitions at most. ``n_items``, if known, sets the number of blocks without
    counting ``items``, which would compute their sizes once more.
    """
    if capacity < 1 or open_bins < 1:
        raise ValueError("capacity and open_bins must be at least 1")
    blocks = max(1, -(-(items.count() if n_items is None else n_items) // items_per_block))
    tasks = min(blocks, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = items.schema[id_].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, fit = None, None
        for batch in batches:
            ids, sizes, numbers = (batch.column(i).to_pylist() for i in range(3))
            rows: tuple[list, ...] = ([], [], [], [], [])
            for i, n, b in zip(ids, sizes, numbers, strict=True):
                if b != block:
                    block, fit = b, BestFit(capacity, open_bins)
                whole, rest = divmod(n, capacity)
                cuts = [(capacity, fit.place_whole()) for _ in range(whole)]
                if rest or not whole:
                    cuts.append((rest, fit.place(rest)))
                for k, (length, bin_) in enumerate(cuts):
                    for column, v in zip(rows, (i, k, k * capacity, length, b * CONTAINERS_PER_BLOCK + bin_), strict=True):
                        column.append(v)
            types = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["id", "part", "start", "n_tokens", "container"])

    sized = items.select(
        items[id_].alias("id"), F.coalesce(items[size].cast("int"), F.lit(0)).alias("n"),
        F.pmod(F.xxhash64(items[id_]), F.lit(blocks)).alias("block"), F.xxhash64(items[id_], F.lit(1)).alias("turn"),
    )
    spread = sized.repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int")).sortWithinPartitions("block", "turn", "id", "n")
    out = spread.select("id", "n", "block").mapInArrow(work, f"id {kind}, part int, start bigint, n_tokens int, container bigint")
    return out.withColumnRenamed("id", id_)


def container_fill(parts: DataFrame, capacity: int = 512) -> DataFrame:
    """(container, n_parts, used, free) of each container."""
    return parts.groupBy("container").agg(F.count(F.lit(1)).alias("n_parts"), F.sum("n_tokens").alias("used")).withColumn("free", F.lit(capacity) - F.col("used"))
