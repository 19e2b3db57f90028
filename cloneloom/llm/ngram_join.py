"""Similarity self-join on word shingles: chosen-path join.

Every set of shingles chooses some of its tokens by hash, ``MEAN /
similarity`` of them in expectation, and enters the bucket of each. Two sets
with the wanted similarity share ``MEAN`` chosen tokens in expectation, as a
token's hash decides alike in both. Buckets that hold many unlike sets are
split again by newly chosen tokens until a path has ``DEPTH`` of them, each on
its own even where others have the same members; all others are compared
exactly, large ones in tiles. Tokens to split by come from a pool that each
set draws apart from its first choices. Independent runs are repeated until a
pair's chance to meet reaches the target recall.

Work stays in proportion: equal sets are one; buckets with the same members
are compared once; a bucket yields per-set counts and a spanning forest, not pairs; and
a pair that meets in several buckets counts in the least only. Sketches of 128
bytes tell which sets of a bucket can have a partner there; only for those are
texts read again and whole sets compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import join_groups, text_of, written

SIMILARITY = 0.8

RECALL = 0.9999

#: Shared chosen tokens that a pair at the wanted similarity has in a run.
MEAN = 2.0

DEPTH = 3

#: Tokens in the pool that splits choose from, which a pair at the wanted
#: similarity shares in expectation.
POOL = 48.0

#: Sets up to which a bucket is compared at once.
SMALL = 64

#: A large bucket is compared in tiles if two members agree with this chance
#: on the least of their chosen tokens in one of some orders; splitting would
#: not part them.
ALIKE = 0.4
ORDERS = 2

TILE = 512

#: Bins of a sketch (one-permutation MinHash), and the similarity estimated
#: from it under which a pair isn't compared. It is five deviations of the
#: estimate below the wanted similarity.
BINS = 64
FIVE_DEVIATIONS = 5.0

#: Sets of fewer shingles leave bins empty and are compared without a sketch.
SKETCHED = 256

_U = np.uint64
_TOP = float(2**64)


def _missed(runs: int, depth: int, mean: float, pool: float) -> float:
    """Chance that a pair at the wanted similarity never meets in ``runs``
    runs, even if its buckets are split at each depth. All splits of a pair
    choose from the pool tokens it shares, whose number is a Poisson one."""
    total = 0.0
    for shared in range(int(pool + 12 * math.sqrt(pool)) + 1):
        survive = 1.0
        for _ in range(depth - 1):
            survive = 1 - math.exp(-mean * shared / pool * survive)
        total += math.exp(shared * math.log(pool) - pool - math.lgamma(shared + 1) - mean * runs * survive)
    return total


def runs_for(recall: float, depth: int = DEPTH, mean: float = MEAN, pool: float = POOL) -> int:
    """Runs after which a pair at the wanted similarity has met with
    probability ``recall``, even if its buckets were split at each depth."""
    runs = 1
    while _missed(runs, depth, mean, pool) > 1 - recall:
        runs += 1
    return runs


def _chosen(tokens: np.ndarray, path: int, similarity: float, mean: float = MEAN) -> np.ndarray:
    """Bucket keys of the tokens that a set chooses on ``path``."""
    if not len(tokens):
        return tokens
    keys = kernels.splitmix(tokens ^ kernels.splitmix(np.array([path & (2**64 - 1)], _U)))
    rate = mean / (similarity * len(tokens))
    return keys if rate >= 1 else keys[keys < _U(int(rate * _TOP))]


def _set_id(tokens: np.ndarray) -> bytes:
    """128 bits that depend on the set alone."""
    one = np.add.reduce(kernels.splitmix(tokens), dtype=_U)
    two = np.add.reduce(kernels.splitmix(tokens ^ _U(0xA5A5A5A5DEADBEEF)), dtype=_U)
    return int(one).to_bytes(8, "big") + int(two).to_bytes(8, "big")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _lists(parts: list[np.ndarray], dtype=np.int64) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.from_numpy_dtype(dtype)))


_BIN_STARTS = np.arange(BINS, dtype=_U) << _U(64 - BINS.bit_length() + 1)


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """Sixteen bits of the least token in each bin of the hash range; 0 if the
    bin is empty. The tokens are sorted."""
    at = np.searchsorted(tokens, _BIN_STARTS)
    ends = np.append(at[1:], len(tokens))
    out = np.zeros(BINS, np.uint16)
    full = at < ends
    out[full] = kernels.splitmix(tokens[at[full]]).astype(np.uint16) | np.uint16(1)
    return out


def _keys_of(runs: int, similarity: float):
    def run(batches):
        for batch in batches:
            ids, sizes, keys, pools, sketches = [], [], [], [], []
            for _, own in kernels.shingle_sets(batch.column(1)):
                ids.append(_set_id(own) if len(own) else None)
                sizes.append(len(own))
                keys.append(_signed(np.concatenate([_chosen(own, r + 1, similarity) for r in range(runs)])))
                pools.append(_chosen(own, 0, similarity, POOL).astype(np.uint32).view(np.int32))
                sketches.append(_sketch(own).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), _lists(keys), _lists(pools, np.int32), pa.array(sketches, pa.binary())],
                names=["doc_id", "mark", "sid", "n", "keys", "pool", "sketch"],
            )

    return run


def _tokens_of(batches):
    """(sid, shingles) of (sid, text)."""
    for batch in batches:
        ids, sets = [], []
        for k, own in kernels.shingle_sets(batch.column(1)):
            if _set_id(own) == batch.column(0)[k].as_py():
                ids.append(batch.column(0)[k].as_py())
                sets.append(own.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(sets, pa.binary())], names=["sid", "tokens"])


def _common(parts: list[np.ndarray], step: int = 1 << 22) -> np.ndarray:
    """How many elements each two of several sets share, exactly."""
    m = len(parts)
    out = np.zeros((m, m), np.int64)
    lengths = [len(p) for p in parts]
    flat = np.concatenate(parts) if parts else np.zeros(0)
    if not len(flat):
        return out
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), lengths)
    shared = count[at] > 1
    if not shared.any():
        return out
    row, at = row[shared], np.unique(at[shared], return_inverse=True)[1]
    wide = max(1, step // m)
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for low in range(0, int(at[-1]) + 1, wide):
        a, b = np.searchsorted(at, [low, low + wide])
        held = np.zeros((m, min(wide, int(at[-1]) + 1 - low)), np.float32)
        held[row[a:b], at[a:b] - low] = 1
        out += np.rint(held @ held.T).astype(np.int64)
    return out


def _open_pairs(bucket: int, crossing: bool, blocks: tuple, lists: tuple) -> np.ndarray:
    """Which two sets of a tile are to be compared in it: of different blocks,
    if it crosses two, and with no lesser bucket in common."""
    m = len(blocks)
    before = _common([np.array([b for b in own if b < bucket], np.int64) for own in lists]) > 0
    block = np.array(blocks)
    apart = block[:, None] != block[None, :] if crossing else np.ones((m, m), bool)
    return apart & ~before & ~np.eye(m, dtype=bool)


def _sift(bucket: int, crossing: bool, rows: list[tuple], similarity: float) -> Iterator[tuple]:
    """The rows of a tile that can have a partner in it, without size and
    sketch."""
    _, _, blocks, lists, sizes, sketches = zip(*rows, strict=True)
    open_ = _open_pairs(bucket, crossing, blocks, lists)
    size = np.array(sizes, np.int64)
    low, high = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
    open_ &= low >= similarity * high - 1e-9
    busy = np.flatnonzero(open_.any(1))
    if not len(busy):
        return
    sketch = np.frombuffer(b"".join(sketches[k] for k in busy), np.uint16).reshape(len(busy), BINS)
    same, empty = np.zeros((2, len(busy), len(busy)), np.int16)
    for b in range(BINS):
        own = sketch[:, b]
        equal = own[:, None] == own[None, :]
        empty += equal & (own == 0)[:, None]
        same += equal
    bins = BINS - empty
    least = similarity * bins - FIVE_DEVIATIONS * np.sqrt(similarity * (1 - similarity) * bins)
    near = (same - empty >= least) | (low[np.ix_(busy, busy)] < SKETCHED)
    for k in np.flatnonzero((open_[np.ix_(busy, busy)] & near).any(1)):
        yield rows[busy[k]][:4]


def _compare(bucket: int, crossing: bool, rows: list[tuple], similarity: float) -> Iterator[tuple]:
    """(sid, root, links) of the sets of a tile that have a link in it."""
    ids, weights, blocks, lists, sets = zip(*rows, strict=True)
    open_ = _open_pairs(bucket, crossing, blocks, lists)
    busy = np.flatnonzero(open_.any(1))
    if not len(busy):
        return
    own = [np.frombuffer(sets[k], _U) for k in busy]
    size = np.array([len(s) for s in own])
    shared = _common(own)
    linked = shared * (1 + similarity) >= similarity * (size[:, None] + size[None, :]) - 1e-9
    linked &= open_[np.ix_(busy, busy)]
    links = linked @ np.array(weights, np.int64)[busy]
    label = np.arange(len(busy))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(busy)).min(1))
        least = least[least]
        if (least == label).all():
            break
        label = least
    for k in np.flatnonzero(links):
        yield ids[busy[k]], ids[busy[label[k]]], int(links[k])


TILE_SCHEMA = "bucket long, i int, j int, sid binary, mult long, block int, buckets array<long>"

LINK_SCHEMA = "sid binary, root binary, links long"


def _by_tile(work, similarity: float, with_tile: bool):
    """Streams rows sorted by (bucket, i, j); holds one tile at a time. Rows
    of the same set count once."""
    link_types = [pa.binary(), pa.binary(), pa.int64()]
    tile_types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
    types = tile_types if with_tile else link_types
    names = [c.split()[0] for c in (TILE_SCHEMA if with_tile else LINK_SCHEMA).split(", ")]

    def run(batches):
        now, rows, out = None, {}, []

        def close():
            if len(rows) > 1:
                got = work(now[0], now[1] != now[2], list(rows.values()), similarity)
                out.extend((*now, *r) if with_tile else r for r in got)

        def batch_of():
            columns = zip(*out, strict=True) if out else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for bucket, i, j, *row in zip(*columns, strict=True):
                if (bucket, i, j) != now:
                    close()
                    now, rows = (bucket, i, j), {}
                rows[row[0]] = tuple(row)
            yield batch_of()
            out.clear()
        close()
        yield batch_of()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(sid, root): the least sid of each connected component of (sid, root).

    Alternates large-star and small-star steps, which keep the components and
    end in stars after a logarithmic number of rounds; every round is written.
    """

    def star(table: DataFrame, both: bool) -> DataFrame:
        around = table.select(F.col("sid").alias("u"), F.col("root").alias("v"))
        if both:
            around = around.unionByName(table.select(F.col("root").alias("u"), F.col("sid").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("size"))
        least = least.withColumn("m", F.least("m", "u"))
        joined = join_groups(around, written(least, "least"), ["u"], "size", n_rows)
        if both:
            out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("sid"), F.col("m").alias("root"))
        else:
            out = joined.select(F.col("v").alias("sid"), F.col("m").alias("root")).unionByName(joined.select(F.col("u").alias("sid"), F.col("m").alias("root")))
        return out.filter(F.col("sid") != F.col("root")).distinct()

    def falling(table: DataFrame) -> DataFrame:
        return table.select(F.greatest("sid", "root").alias("sid"), F.least("sid", "root").alias("root"))

    def state(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count(F.lit(1)), F.sum(F.xxhash64("sid", "root").cast("decimal(38,0)"))).first())

    now = written(falling(edges).filter(F.col("sid") != F.col("root")).distinct(), "edges")
    n_rows = now.count()
    seen = state(now)
    while n_rows:
        now = written(star(written(star(now, True), "large_star"), False), "small_star")
        was, seen = seen, state(now)
        if seen == was:
            break
    return now


def _in_order(k: int):
    return lambda key: F.xxhash64(key, F.lit(k))


def _links(docs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(sid, root, links) found in buckets; sets: (sid, n, mult, row, keys, pool, sketch);
    docs: (doc_id, text, mark)."""

    def sized(rows: DataFrame) -> DataFrame:
        """Rows of buckets with two members or more, with their number. Of
        buckets with the same members, one does; ``paths`` of a large one are
        all that it stands for."""
        rows = written(rows, "bucket_rows")
        mark = F.xxhash64("sid")
        groups = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.sum(mark.cast("decimal(38,0)")).alias("mark"))
        groups = written(groups.filter("members > 1"), "bucket_sizes")
        few = groups.filter(F.col("members") <= SMALL).groupBy("members", "mark").agg(F.min("bucket").alias("bucket"))
        many = groups.filter(F.col("members") > SMALL).groupBy("members", "mark").agg(F.min("bucket").alias("bucket"), F.collect_list("bucket").alias("paths"))
        few = few.select("bucket", "members", F.lit(None).cast("array<long>").alias("paths"))
        groups = few.unionByName(many.select("bucket", "members", "paths"))
        return written(join_groups(rows, written(groups, "buckets"), ["bucket"], "members", max(1, rows.count())), "shared_rows")

    level = sized(sets.select(F.explode("keys").alias("bucket"), "sid"))
    leaves: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        leaves.append(level.filter(F.col("members") <= SMALL))
        large = level.filter(F.col("members") > SMALL)
        if large.isEmpty():
            break
        if depth == DEPTH:
            leaves.append(large)
            break
        # the least of a member's keys in a few orders, as in MinHash
        others = F.filter("keys", lambda k: k != F.col("bucket"))
        least = F.array(*(F.array_min(F.transform(others, _in_order(k))) for k in range(ORDERS)))
        seen = large.join(sets.select("sid", "keys"), "sid").select("bucket", "members", F.explode(least).alias("key"))
        seen = seen.groupBy("bucket", "members", "key").agg(F.count(F.lit(1)).cast("double").alias("c"))
        share = seen.groupBy("bucket").agg((F.sum(F.col("c") * F.col("c")) / (F.first("members") * F.sum("c"))).alias("share"), F.first("members").alias("members"))
        share = written(share.select("bucket", (F.col("share") >= ALIKE).alias("alike"), "members"), "shares")
        judged = written(join_groups(large.drop("members"), share, ["bucket"], "members", max(1, level.count())), "judged")
        leaves.append(judged.filter("alike").select("bucket", "sid", "members"))
        # split by tokens of the set's pool, chosen anew on each path
        again = judged.filter("not alike").select("sid", "paths").join(sets.select("sid", "n", "pool"), "sid")
        rate = F.greatest(F.lit(MEAN / POOL), MEAN / (similarity * F.col("n")))
        taken = lambda key: F.pmod(key, F.lit(1 << 30)) < rate * (1 << 30)
        parts = F.transform("paths", lambda path: F.filter(F.transform("pool", lambda key: F.xxhash64(path, key)), taken))
        level = sized(again.select(F.explode(F.flatten(parts)).alias("bucket"), "sid"))

    rows = leaves[0].select("bucket", "sid", "members")
    for leaf in leaves[1:]:
        rows = rows.unionByName(leaf.select("bucket", "sid", "members"))
    own = rows.groupBy("sid").agg(F.collect_list(F.struct("bucket", "members")).alias("at"))
    full = own.join(sets.select("sid", "mult", "n", "sketch"), "sid")
    full = full.select("sid", "mult", F.col("at.bucket").alias("buckets"), "n", "sketch", F.explode("at").alias("b"))
    blocks = F.ceil(F.col("b.members") / TILE).cast("int")
    full = full.withColumn("block", F.pmod(F.xxhash64("sid"), blocks).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tile = [F.col("b.bucket").alias("bucket"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    at = ["bucket", "i", "j"]
    tiled = full.select(*tile, "sid", "mult", "block", "buckets", "n", "sketch").repartition(*at).sortWithinPartitions(*at)
    busy = written(tiled.mapInArrow(_by_tile(_sift, similarity, True), TILE_SCHEMA), "busy")

    # one row stands for a set; its text's hash parts it from rows with its id
    wanted = busy.select("sid").distinct().join(sets.select("sid", "row"), "sid")
    wanted = written(wanted.select("sid", F.col("row.doc_id").alias("_id"), F.col("row.mark").alias("mark")), "wanted")
    named = docs.join(wanted.hint("merge"), (docs["mark"] == wanted["mark"]) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("sid", "text")
    tokens = written(named.mapInArrow(_tokens_of, "sid binary, tokens binary"), "tokens")
    if tokens.count() > wanted.count():  # rows that are wholly repeated
        tokens = written(tokens.groupBy("sid").agg(F.first("tokens").alias("tokens")), "tokens")
    whole = busy.join(tokens, "sid").select(*at, "sid", "mult", "block", "buckets", "tokens").repartition(*at).sortWithinPartitions(*at)
    return written(whole.mapInArrow(_by_tile(_compare, similarity, False), LINK_SCHEMA), "links")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, n_links.

    Documents are linked if the Jaccard similarity of their five-word shingle
    sets is ``similarity`` or more; ``n_links`` counts the others a document is
    linked with, copies included. ``class_id`` is the least id among those
    that links connect. A text with one to four words has one shingle of them
    all; a text without a word, or null, has no link. Very long texts count
    with all their shingles. Rows with the same id, or none, are linked by
    their texts like others; other columns are ignored, whatever their names.
    An empty table stays empty. Links between the distinct texts of a group of
    near copies are all counted, in tiles over the cluster, which is quadratic
    in their number.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    keyed = written(rows.mapInArrow(_keys_of(runs_for(recall), similarity), "doc_id long, mark long, sid binary, n long, keys array<long>, pool array<int>, sketch binary"), "keyed")
    n_rows = keyed.count()
    sets = keyed.filter("sid is not null").groupBy("sid").agg(
        F.first("n").alias("n"), F.count(F.lit(1)).alias("mult"), F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "mark")).alias("row"), F.first("keys").alias("keys"), F.first("pool").alias("pool"), F.first("sketch").alias("sketch")
    )
    sets = written(sets, "sets")
    links = _links(rows, sets, similarity)
    total = links.groupBy("sid").agg(F.sum("links").alias("links"))
    root = components(links.select("sid", "root"))
    known = sets.select("sid", "mult", "rep").join(total, "sid", "left").join(root, "sid", "left")
    known = written(known.select("sid", "mult", "rep", F.coalesce("root", "sid").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "known")
    classes = known.groupBy("root").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("size"))
    known = written(join_groups(known, written(classes, "classes"), ["root"], "size", n_rows), "classified")
    mine = join_groups(keyed.filter("sid is not null").select("doc_id", "sid"), known.select("sid", "mult", "class_id", "links"), ["sid"], "mult", n_rows)
    out = mine.select("doc_id", "class_id", (F.col("links") + F.col("mult") - 1).cast("long").alias("n_links"))
    alone = keyed.filter("sid is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(alone)


def one_per_class(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with the least id of their class, all columns kept.

    Rows that share an id stay or go together; a row with a null id stays.
    """
    found = near_duplicates(docs, similarity, id_col=id_col, text_col=text_col)
    gone = written(found.filter("doc_id <> class_id").select(F.col("doc_id").alias(id_col)).distinct(), "near_copies")
    # near copies grow with the documents, so they aren't for broadcasting
    return docs.join(gone.hint("merge"), id_col, "left_anti").select(*docs.columns)
