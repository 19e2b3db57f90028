"""Token-id files in Simple-8b word-aligned coding.

A file is a Parquet part whose rows are segments: whole documents in ascending
order of id, their token counts, and their ids as one stream, cut in blocks of
``BLOCK`` ids. Each 64-bit word holds a selector in its top four bits and as
many ids as its selector says in the other sixty. ``word_at`` has the first
word of each block, so blocks can be decoded on their own and all words of a
segment at once. A value that needs more than sixty bits is escaped: its place
holds the largest 60-bit number and the value stands in ``escapes``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import table_path, text_of

# Fixed values of Simple-8b: (ids in a word, bits of each) by selector.
SELECTORS = (
    (240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
)

BLOCK = 1024

#: Ids after which a segment ends with the document.
SEGMENT = 1 << 17

ESCAPE = (1 << 60) - 1

_U = np.uint64


_WIDTHS = np.array([v.bit_length() for v in range(1 << 16)], np.uint8)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    out = _WIDTHS[values & _U(0xFFFF)]
    for shift in (16, 32, 48):
        big = values >> _U(shift)
        if not big.any():
            break
        out = np.where(big > 0, _WIDTHS[big & _U(0xFFFF)] + np.uint8(shift), out)
    return out


def _runs(bits: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of places that need ``width`` bits or fewer,
    found from the fewer of such places and the others."""
    narrow = bits <= width
    if 2 * np.count_nonzero(narrow) < len(bits):
        at = np.flatnonzero(narrow)
        if not len(at):
            return at, at
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        return at[first], at[np.append(first[1:], len(at)) - 1] + 1
    edges = np.concatenate([[-1], np.flatnonzero(~narrow), [len(bits)]])
    return edges[:-1] + 1, edges[1:]


def _tails(best: np.ndarray, bits: np.ndarray) -> None:
    """Fit the last words of equally long blocks (rows), which may hold fewer
    ids than their selectors say."""
    reach = min(bits.shape[1], SELECTORS[0][0])
    widest = np.maximum.accumulate(bits[:, : -reach - 1 : -1], axis=1)
    left = np.arange(1, reach + 1)
    found = np.full(widest.shape, len(SELECTORS) - 1, np.uint8)
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, width = SELECTORS[s]
        found[(widest <= width) & (left < count)] = s
    ends = best[:, : -reach - 1 : -1]
    np.minimum(ends, found, out=ends)


def _first_fit(bits: np.ndarray, block: int) -> np.ndarray:
    """For each place the first selector whose word can start there.

    A selector of ``n`` ids of ``b`` bits fits where none of the next ``n`` is
    wider, or none up to the block's end. Such places form ranges; only runs
    that are long enough, and the tails of blocks, are touched.
    """
    n = len(bits)
    best = np.full(n, len(SELECTORS) - 1, np.uint8)
    for s in range(len(SELECTORS) - 2, -1, -1):
        count, width = SELECTORS[s]
        start, end = _runs(bits, width)
        long = np.flatnonzero(end - start >= count)
        if len(long):
            step = np.zeros(n + 1, np.int8)
            step[start[long]] += 1
            step[end[long] - count + 1] -= 1
            best[np.cumsum(step[:-1], dtype=np.int8).view(bool)] = s
    whole = n // block * block
    if whole:
        _tails(best[:whole].reshape(-1, block), bits[:whole].reshape(-1, block))
    if n > whole:
        _tails(best[None, whole:], bits[None, whole:])
    return best


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escapes) of unsigned 64-bit values.

    Words follow one another inside a block only, so all blocks are walked in
    step, one word of each at a time.
    """
    values = values.astype(_U)
    escaped = values >= _U(ESCAPE)
    escapes = values[escaped]
    small = np.where(escaped, _U(ESCAPE), values)
    bounds = np.append(np.arange(0, len(small), block), len(small))
    if len(bounds) < 2:
        return np.zeros(0, _U), np.zeros(0, np.int64), escapes
    selector = _first_fit(_bits(small), block)
    sizes = np.array([s[0] for s in SELECTORS])
    at, end = bounds[:-1].copy(), bounds[1:]
    starts, open_ = np.zeros(len(small), bool), np.arange(len(at))
    while len(open_):
        starts[at[open_]] = True
        at[open_] += sizes[selector[at[open_]]]
        open_ = open_[at[open_] < end[open_]]
    start = np.flatnonzero(starts)
    chosen = selector[start]
    words = chosen.astype(_U) << _U(60)
    stop = np.append(start[1:], len(small))
    held = stop - start
    for s, (count, width) in enumerate(SELECTORS):
        if not width:
            continue
        mine = np.flatnonzero((chosen == s) & (held >= count))
        packed, at = np.zeros(len(mine), _U), start[mine]
        for k in range(count if len(mine) else 0):
            packed |= small[at + k] << _U(k * width)
        words[mine] |= packed
    for w in np.flatnonzero(held < sizes[chosen]):  # last words of blocks
        width = SELECTORS[chosen[w]][1]
        for k in range(held[w] if width else 0):
            words[w] |= small[start[w] + k] << _U(k * width)
    return words, np.searchsorted(start, bounds[:-1]), escapes


def decode(words: np.ndarray, n: int, word_at: np.ndarray, escapes: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The ``n`` values of all blocks, unpacked by selector."""
    out = np.zeros(n, _U)
    if not n:
        return out
    selector = (words >> _U(60)).astype(np.int64)
    sizes = np.array([s[0] for s in SELECTORS])[selector]
    # where each word's values go: counted from its block's first word
    filled = np.cumsum(sizes) - sizes
    own = np.searchsorted(word_at, np.arange(len(words)), "right") - 1
    start = own * block + filled - filled[word_at][own]
    stop = np.minimum((own + 1) * block, n)
    for s, (count, width) in enumerate(SELECTORS):
        mine = np.flatnonzero(selector == s)
        if not width or not len(mine):
            continue
        mask = _U((1 << width) - 1)
        for k in range(count):
            held = mine[start[mine] + k < stop[mine]]
            out[start[held] + k] = (words[held] >> _U(k * width)) & mask
    if len(escapes):
        out[out == _U(ESCAPE)] = escapes
    return out


SEGMENT_SCHEMA = "shard int, segment int, n_ids long, doc_ids array<long>, n_tokens array<long>, word_at array<int>, words binary, escapes binary"


def _segments(path: str, end_id: int):
    """Segments of a partition's documents, which come in order."""

    def run(batches):
        shard, number = TaskContext.get().partitionId(), 0
        docs: list = []
        parts: list[np.ndarray] = []
        size = 0

        def segment():
            ids = np.concatenate(parts)
            words, at, escapes = encode(ids)
            row = [shard, number, len(ids), docs, [len(p) for p in parts], at.tolist(), words.tobytes(), escapes.tobytes()]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            names = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for batch in batches:
            ids = batch.column(0)
            for k, own in tokens.encode(batch.column(batch.num_columns - 1), path, end_id):
                docs.append(ids[k].as_py())
                parts.append(own)
                size += len(own)
                if size >= SEGMENT:
                    yield segment()
                    docs, parts, size, number = [], [], 0, number + 1
        if parts:
            yield segment()

    return run


def write_files(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = tokens.END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenize whole texts and write them to ``path`` in ascending id order.

    Null ids come first, rows with the same id in the order of a hash of their
    texts; a null text has its end id only. Each partition of the order is one
    shard, numbered along the order.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # the hash parts rows with the same id, or none, so that no task gets them all
    rows = rows.withColumn("mark", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("mark")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    dealt.mapInArrow(_segments(tokenizer or tokens.default_tokenizer(), end_id), SEGMENT_SCHEMA).write.parquet(path)


def _documents(batches):
    """(shard, segment, nth, doc_id, before, n_tokens, ids_crc32) of segments."""
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for row in batch.to_pylist():
            ids = decode(
                np.frombuffer(row["words"], _U), row["n_ids"], np.array(row["word_at"], np.int64), np.frombuffer(row["escapes"], _U)
            ).astype("<u4")
            at = 0
            for nth, (doc, n) in enumerate(zip(row["doc_ids"], row["n_tokens"], strict=True)):
                crc = zlib.crc32(ids[at : at + n].tobytes())
                for c, v in zip(out, (row["shard"], row["segment"], nth, doc, at, n, crc), strict=True):
                    c.append(v)
                at += n
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["shard", "segment", "nth", "doc_id", "before", "n_tokens", "ids_crc32"])


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens,
    ids_crc32. ``start`` counts the ids of all documents before it."""
    table = spark.read.parquet(path)
    # one row a segment, then one a shard: the shards' totals are few
    totals = table.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shard_base = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_base"))
    inside = Window.partitionBy("shard").orderBy("segment")
    base = table.select("shard", "segment", "n_ids").withColumn("base", F.sum("n_ids").over(inside) - F.col("n_ids"))
    base = base.join(shard_base, "shard").select("shard", "segment", (F.col("base") + F.col("shard_base")).alias("base"))
    rows = table.mapInArrow(_documents, "shard int, segment int, nth int, doc_id long, before long, n_tokens long, ids_crc32 long")
    joined = rows.join(base, ["shard", "segment"])
    return joined.select("doc_id", (F.col("base") + F.col("before")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str | None = None, end_id: int = tokens.END_ID) -> DataFrame:
    """Write all documents to files in the shared folder and read them back.

    Null and empty texts, repeated rows, null and repeated ids as in
    ``write_files``; very long texts are encoded whole and make a segment that
    is as long. Other columns are ignored, whatever their names. An empty table
    gives files without segments and no rows.
    """
    spark = docs.sparkSession
    path = table_path(spark, "token_files")
    write_files(docs, path, tokenizer, end_id)
    return read_documents(spark, path)
