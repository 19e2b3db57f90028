"""Sharding by best-fit decreasing over indivisible groups of equal texts.

Groups enter, largest first, the shard with the least room that still takes
them; rooms are held in a balanced tree. The capacity is the least, found by
bisection, at which the packing needs no more than the wanted shards, so the
shards' bytes come out near equal.

To stay bounded, groups smaller than a small share of a shard are first packed
by the same rule, inside each partition, into parcels of about that share.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, rank_in_groups, salts_for, text_of, written

SHARDS = 8

#: A parcel holds at most this share of one shard.
PARCELS_PER_SHARD = 512


class RoomTree:
    """An AA tree (a balanced binary tree) of (room, number), with the least
    room that is enough found in logarithmic time."""

    class _Node:
        __slots__ = ("key", "left", "level", "right")

        def __init__(self, key: tuple[int, int]):
            self.key, self.level = key, 1
            self.left: RoomTree._Node | None = None
            self.right: RoomTree._Node | None = None

    def __init__(self) -> None:
        self._root: RoomTree._Node | None = None

    @staticmethod
    def _skew(n):
        if n and n.left and n.left.level == n.level:
            low = n.left
            n.left, low.right = low.right, n
            return low
        return n

    @staticmethod
    def _split(n):
        if n and n.right and n.right.right and n.right.right.level == n.level:
            high = n.right
            n.right, high.left = high.left, n
            high.level += 1
            return high
        return n

    def _put(self, n, key):
        if n is None:
            return self._Node(key)
        if key < n.key:
            n.left = self._put(n.left, key)
        else:
            n.right = self._put(n.right, key)
        return self._split(self._skew(n))

    def _cut(self, n, key):
        if n is None:
            return None
        if key == n.key:
            if n.left is None and n.right is None:
                return None
            if n.left is None:
                heir = n.right
                while heir.left:
                    heir = heir.left
                n.key, n.right = heir.key, self._cut(n.right, heir.key)
            else:
                heir = n.left
                while heir.right:
                    heir = heir.right
                n.key, n.left = heir.key, self._cut(n.left, heir.key)
        elif key < n.key:
            n.left = self._cut(n.left, key)
        else:
            n.right = self._cut(n.right, key)
        low = min(n.left.level if n.left else 0, n.right.level if n.right else 0) + 1
        if low < n.level:
            n.level = low
            if n.right and low < n.right.level:
                n.right.level = low
        n = self._skew(n)
        n.right = self._skew(n.right)
        if n.right:
            n.right.right = self._skew(n.right.right)
        n = self._split(n)
        n.right = self._split(n.right)
        return n

    def add(self, room: int, number: int) -> None:
        self._root = self._put(self._root, (room, number))

    def remove(self, room: int, number: int) -> None:
        self._root = self._cut(self._root, (room, number))

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The entry with the least room of ``size`` or more."""
        n, best = self._root, None
        while n:
            if n.key[0] >= size:
                best, n = n.key, n.left
            else:
                n = n.right
        return best


def best_fit(sizes: Iterable[int], capacity: int, most: int | None = None) -> Iterator[int]:
    """The bin of each size, the sizes falling; stops early when more than
    ``most`` bins would be needed. A size over the capacity gets a bin alone."""
    tree, bins = RoomTree(), 0
    for size in sizes:
        found = tree.tightest(size)
        if found is None:
            if most is not None and bins >= most:
                return
            room, number = max(capacity, size), bins
            bins += 1
        else:
            room, number = found
            tree.remove(room, number)
        if room > size:
            tree.add(room - size, number)
        yield number


def fixed_shards(sizes: list[int], shards: int) -> list[int]:
    """Bins of falling sizes with the least capacity at which best fit needs
    ``shards`` at most."""
    if not sizes:
        return []
    low = max(sizes[0], -(-sum(sizes) // shards))
    high = max(low, 2 * low)
    best: list[int] | None = None
    while low <= high:
        middle = (low + high) // 2
        got = list(best_fit(sizes, middle, shards))
        if len(got) == len(sizes):
            best, high = got, middle - 1
        else:
            low = middle + 1
            if best is None and low > high:
                high = 2 * high
    assert best is not None
    return best


def _parcels(least: int):
    """Parcels of a partition's small groups, sorted by falling size."""

    def run(batches):
        part = TaskContext.get().partitionId()
        tree, bins = RoomTree(), 0
        for batch in batches:
            names = []
            for size in batch.column(1).to_pylist():
                found = tree.tightest(size)
                if found is None:
                    room, number, bins = max(least, size), bins, bins + 1
                else:
                    room, number = found
                    tree.remove(room, number)
                if room > size:
                    tree.add(room - size, number)
                names.append(f"{part}-{number}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], names=["key", "size", "n", "parcel"])

    return run


def assign(groups: DataFrame, shards: int = SHARDS, parcels_per_shard: int = PARCELS_PER_SHARD) -> DataFrame:
    """Add ``shard`` to a written table of (key string, size long, n long).

    The driver gets only parcels: groups of a parcel's size or more are at most
    ``shards * parcels_per_shard``, and those that partitions make of the
    others are at least half full but for one a partition.
    """
    spark = groups.sparkSession
    total = groups.agg(F.sum("size")).first()[0] or 0
    least = max(1, total // (shards * parcels_per_shard))
    small = groups.filter(F.col("size") < least).repartition("key").sortWithinPartitions(F.desc("size"), "key")
    large = groups.filter(F.col("size") >= least).withColumn("parcel", F.concat(F.lit("g-"), "key"))
    parts = written(small.mapInArrow(_parcels(least), "key string, size long, n long, parcel string").unionByName(large), "parcels")
    sums = parts.groupBy("parcel").agg(F.sum("size").alias("size")).collect()
    sums.sort(key=lambda r: (-r["size"], r["parcel"]))
    bins = fixed_shards([r["size"] for r in sums], shards)
    table = spark.createDataFrame([(r["parcel"], b) for r, b in zip(sums, bins, strict=True)], "parcel string, shard int")
    return parts.join(F.broadcast(table), "parcel").drop("parcel")


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot,
    grown_shard.

    Equal texts (a null counts as empty) share a shard. The law that holds is
    ``bytes``: the shards' sizes are as equal as best fit gets them. A group
    isn't split, so a very long text or a group of very many rows can make one
    shard larger. Groups of one size go in the order of their digests. Repeated
    rows get slots of their own, null ids are ids like others; other columns
    are ignored; an empty table stays empty.
    """
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.sha2(text, 256).alias("key"),
    )
    rows = written(rows, "sizes")
    n_rows = rows.count()
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    placed = written(assign(written(groups, "groups"), shards).select("key", "shard", "n"), "placed")
    joined = written(join_groups(rows, placed, ["key"], "n", n_rows).drop("key", "n"), "sharded")
    ranked = rank_in_groups(joined, ["shard"], ["doc_id", "text_crc32"], salts_for(n_rows), "slot")
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )
