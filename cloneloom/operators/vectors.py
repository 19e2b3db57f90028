"""Opcode frequency vectors and their cosine similarity.

Cosine doesn't depend on scale, so vectors are kept as integer counts, and
``dot / (sqrt(n1) * sqrt(n2))`` of integers gives the same double everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.statements import mnemonic
from ..model import FUNCTION_KEY
from .common import join_groups, written

#: Vectors that are compared at once; larger buckets are cut into tiles.
TILE = 512

#: The same where a vector leaves a tile as one row of sums, in strips of so
#: many rows; larger tiles make fewer copies of a vector.
WIDE_TILE, STRIP = 4096, 256

#: Opcodes whose counts are multiplied at once.
WIDTH = 2048


def opcode_column(cross_arch: bool) -> Column:
    """What counts as an opcode: the family if architectures differ."""
    return F.col("family") if cross_arch else mnemonic(F.col("instruction"))


def opcode_counts(statements: DataFrame, opcode: Column, key: list[str] = FUNCTION_KEY) -> DataFrame:
    """(key, opcode, n, total, frequency) of each function's opcodes."""
    counts = statements.groupBy(*key, opcode.alias("opcode")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*key))
    return counts.withColumn("total", total).withColumn("frequency", F.col("n") / F.col("total"))


def norms(counts: DataFrame, key: list[str] = FUNCTION_KEY) -> DataFrame:
    """(key, norm2, n_opcodes, total)."""
    return counts.groupBy(*key).agg(F.sum(F.col("n") * F.col("n")).alias("norm2"), F.count(F.lit(1)).alias("n_opcodes"), F.sum("n").alias("total"))


def vectors(counts: DataFrame, key: list[str] = FUNCTION_KEY) -> DataFrame:
    """(key, vid, vec, norm2): a function's counts as a sorted array.

    Functions with the same counts have the same ``vid``; they are one vector
    in what follows.
    """
    per = counts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("opcode", "n"))).alias("vec"), F.sum(F.col("n") * F.col("n")).alias("norm2"))
    text = F.concat_ws(",", F.transform("vec", lambda x: F.concat(F.base64(F.encode(x["opcode"], "UTF-8")), F.lit(":"), x["n"].cast("string"))))
    return per.withColumn("vid", F.sha2(text, 256))


def distinct_vectors(vecs: DataFrame) -> DataFrame:
    return vecs.groupBy("vid").agg(F.first("vec").alias("vec"), F.first("norm2").alias("norm2")).filter("norm2 > 0")


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine of two arrays of (opcode, n)."""
    other = F.map_from_entries(b)
    dot = F.aggregate(a, F.lit(0).cast("long"), lambda total, x: total + x["n"] * F.coalesce(F.element_at(other, x["opcode"]), F.lit(0).cast("long")))
    return dot / (F.sqrt(norm_a.cast("double")) * F.sqrt(norm_b.cast("double")))


def _prefixes(distinct: DataFrame, min_similarity: float) -> DataFrame:
    """(vid, norm2, vec, opcode, n, before) of each vector's prefix; ``before``
    are its opcodes before this one.

    Opcodes are put in one order, rare ones first. What stands after a
    vector's prefix is shorter than ``min_similarity`` of it, so two vectors
    with a higher cosine share an opcode of both prefixes.
    """
    flat = distinct.select("vid", F.explode("vec").alias("x")).select("vid", "x.opcode", "x.n")
    held = written(flat.groupBy("opcode").agg(F.count(F.lit(1)).alias("df")), "opcodes")
    parts = F.array_sort(F.collect_list(F.struct("df", "opcode", "n")))
    ranked = join_groups(flat, held, ["opcode"], "df").groupBy("vid").agg(parts.alias("parts"))
    # a little slack, as the exact comparison is made in floating point
    least = max(0.0, min_similarity - 1e-9) ** 2
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.array().cast("array<struct<opcode:string,n:long>>").alias("kept"))

    def step(state, x):
        rest = F.col("norm2") - state["seen"]
        kept = F.when(rest >= F.col("norm2") * least, F.concat(state["kept"], F.array(F.struct(x["opcode"].alias("opcode"), x["n"].alias("n"))))).otherwise(state["kept"])
        return F.struct((state["seen"] + x["n"] * x["n"]).alias("seen"), kept.alias("kept"))

    prefix = F.aggregate("parts", start, step)["kept"]
    rows = distinct.join(ranked, "vid")
    rows = rows.withColumn("prefix", prefix).select("vid", "norm2", "vec", "prefix", F.posexplode("prefix").alias("k", "x"))
    before = F.transform(F.slice("prefix", F.lit(1), F.col("k")), lambda x: x["opcode"])
    return rows.select("vid", "norm2", "vec", "x.opcode", "x.n", before.alias("before"))


def _tiles(entries: DataFrame, keys: list[str], min_similarity: float, most: int = TILE, carried: tuple[str, ...] = ("vid",)) -> DataFrame:
    """(class_key, tile, crossing, block, guest, norm2, vec, and what is
    carried), sorted by tile: which vectors meet where.

    Those of one opcode are dealt into cells by their angle to its axis. Two
    vectors with a cosine over ``min_similarity`` differ in that angle by less
    than the angle between them, so a vector is at home in its cell and a guest
    in the next one. Crowded cells are cut into blocks, which meet two at a
    time.
    """
    wide = max(math.acos(min(1.0, max(0.0, min_similarity))), 1e-4) + 1e-6
    angle = F.acos(F.least(F.lit(1.0), F.col("n") / F.sqrt(F.col("norm2").cast("double"))))
    cell = F.floor(angle / wide).cast("int")
    places = F.array(F.struct(cell.alias("cell"), F.lit(False).alias("guest")), F.struct((cell + 1).alias("cell"), F.lit(True).alias("guest")))
    rows = entries.withColumn("at", F.explode(places)).select(*keys, "at.cell", "at.guest", F.xxhash64("vid").alias("dealt"), "norm2", "vec", *carried)
    rows = written(rows, "cell_rows")
    at = [*keys, "cell"]
    sizes = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("members"), F.sum(F.when(F.col("guest"), 0).otherwise(1)).alias("at_home"))
    sizes = written(sizes.filter("at_home > 0 and members > 1").drop("at_home"), "cell_sizes")
    rows = join_groups(rows, sizes, at, "members")
    blocks = F.ceil(F.col("members") / most).cast("int")
    rows = rows.withColumn("block", F.pmod("dealt", blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    place = [F.col(k) for k in keys if k != "opcode"]
    tile = F.concat_ws("/", *place, F.col("cell").cast("string"), low.cast("string"), high.cast("string"), "opcode")
    klass = F.col("class_key") if "class_key" in keys else F.lit("")
    rows = rows.select(klass.alias("class_key"), tile.alias("tile"), (low != high).alias("crossing"), "block", "guest", "norm2", "vec", *carried)
    return rows.repartition("tile").sortWithinPartitions("tile")


def _dots(vecs: pa.Array) -> np.ndarray:
    """Products of each two of several sparse count vectors, exactly."""
    m = len(vecs)
    out = np.zeros((m, m))
    lengths = np.diff(vecs.offsets.to_numpy())
    flat = vecs.flatten()
    codes = flat.field("opcode").dictionary_encode().indices.to_numpy()
    counts = flat.field("n").to_numpy().astype(np.float64)
    row = np.repeat(np.arange(m), lengths)
    for low in range(0, int(codes.max(initial=-1)) + 1, WIDTH):
        here = (codes >= low) & (codes < low + WIDTH)
        held = np.zeros((m, min(WIDTH, int(codes.max()) + 1 - low)))
        held[row[here], codes[here] - low] = counts[here]
        out += held @ held.T
    return out


def _pairs_of(tile: pa.Table, min_similarity: float) -> pa.RecordBatch:
    """(class_key, a, b, similarity) of a tile's vectors."""
    tile = tile.combine_chunks()
    length = np.sqrt(tile.column("norm2").to_numpy().astype(np.float64))
    guest, block = tile.column("guest").to_numpy(), tile.column("block").to_numpy()
    vecs = tile.column("vec").chunk(0) if tile.num_rows else None
    similarity = _dots(vecs) / (length[:, None] * length[None, :])
    near = np.triu(similarity > min_similarity, 1) & ~(guest[:, None] & guest[None, :])
    if tile.column("crossing")[0].as_py():
        near &= block[:, None] != block[None, :]
    i, j = np.nonzero(near)
    ids = tile.column("vid").combine_chunks()
    one, two = ids.take(pa.array(i)), ids.take(pa.array(j))
    less = pc.less(one, two)
    columns = [tile.column("class_key").combine_chunks().take(pa.array(i)), pc.if_else(less, one, two), pc.if_else(less, two, one), pa.array(similarity[i, j])]
    return pa.RecordBatch.from_arrays(columns, names=["class_key", "a", "b", "similarity"])


#: What tells a vector, as three numbers of 40 bits of its digest; their sums
#: over a set of vectors tell the set. Then what is summed over members.
MARKS = ["mark1", "mark2", "mark3"]
SUMS = ["vectors", "size", "id_sum", "id_squares"]


def marks() -> list[Column]:
    return [F.conv(F.substring("vid", 1 + 10 * k, 10), 16, 10).cast("long").alias(name) for k, name in enumerate(MARKS)]


def _indicators(lists: pa.Array) -> np.ndarray:
    """A row of 0 and 1 for each list of words."""
    codes = lists.flatten().dictionary_encode().indices.to_numpy()
    out = np.zeros((len(lists), int(codes.max(initial=-1)) + 1), dtype=np.float32)
    out[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), codes] = 1
    return out


def _near_strips(tile: pa.Table, min_similarity: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, which vectors are similar to each of these) of a tile. Two
    vectors meet for each opcode of both prefixes; the pair counts where none
    of both comes before."""
    m = tile.num_rows
    length = np.sqrt(tile.column("norm2").to_numpy().astype(np.float64))
    guest, block = tile.column("guest").to_numpy(), tile.column("block").to_numpy()
    crossing = tile.column("crossing")[0].as_py()
    counts, before = tile.column("vec").chunk(0), _indicators(tile.column("before").chunk(0))
    lengths, flat = np.diff(counts.offsets.to_numpy()), counts.flatten()
    codes, n = flat.field("opcode").dictionary_encode().indices.to_numpy(), flat.field("n").to_numpy().astype(np.float64)
    row, most = np.repeat(np.arange(m), lengths), int(codes.max(initial=-1)) + 1
    narrow = None
    if most <= WIDTH // 16:
        narrow = np.zeros((m, most))
        narrow[row, codes] = n
    for start in range(0, m, STRIP):
        end = min(m, start + STRIP)
        dots = np.zeros((end - start, m))
        for low in range(0, most, WIDTH // 16):
            held = narrow
            if held is None:
                here = (codes >= low) & (codes < low + WIDTH // 16)
                held = np.zeros((m, min(WIDTH // 16, most - low)))
                held[row[here], codes[here] - low] = n[here]
            dots += held[start:end] @ held.T
        near = dots / (length[start:end, None] * length[None, :]) > min_similarity
        near[np.arange(end - start), np.arange(start, end)] = False
        near &= ~(guest[start:end, None] & guest[None, :])
        if crossing:
            near &= block[start:end, None] != block[None, :]
        if before.shape[1]:
            near &= before[start:end] @ before.T == 0
        yield start, end, near


def _sums_of(tile: pa.Table, min_similarity: float) -> pa.RecordBatch:
    """(class_key, marks, sums of marks and weights over the similar vectors,
    and the least of their places if they have any) of each vector of a tile
    that has such."""
    tile = tile.combine_chunks()
    weights = np.stack([tile.column(c).to_numpy() for c in [*MARKS, *SUMS]], axis=1)
    # limbs of 22 bits, whose sums are exact in doubles
    limbs = np.concatenate([weights & 0x3FFFFF, (weights >> 22) & 0x3FFFFF, weights >> 44], axis=1).astype(np.float64)
    total, k = np.zeros(weights.shape, dtype=np.int64), weights.shape[1]
    place = tile.column("place").to_numpy() if "place" in tile.column_names else None
    least = np.zeros(tile.num_rows, dtype=np.int64)
    for start, end, near in _near_strips(tile, min_similarity):
        found = (near.astype(np.float64) @ limbs).astype(np.int64)
        total[start:end] = found[:, :k] + (found[:, k : 2 * k] << 22) + (found[:, 2 * k :] << 44)
        if place is not None:
            least[start:end] = np.where(near, place[None, :], np.iinfo(np.int64).max).min(axis=1)
    any_near = np.flatnonzero(total[:, len(MARKS)])
    at = pa.array(any_near)
    columns = [tile.column(c).combine_chunks().take(at) for c in ["class_key", *MARKS]]
    columns += [pa.array(total[any_near, i]) for i in range(k)]
    names = ["class_key", *MARKS, *(f"sum_{c}" for c in [*MARKS, *SUMS])]
    if place is not None:
        columns, names = [*columns, pa.array(least[any_near])], [*names, "least"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def _holders_of(tile: pa.Table, min_similarity: float) -> Iterator[pa.RecordBatch]:
    """(vid, equal, classes, sizes) of each vector of a tile: the numbers and
    sizes of the classes whose seed it is similar to. A strip at a time, as
    these are as many as the similar pairs."""
    tile = tile.combine_chunks()
    classes, sizes = tile.column("class").to_numpy(), tile.column("class_size").to_numpy()
    seeds = np.flatnonzero(classes >= 0)
    vid, equal = tile.column("vid").combine_chunks(), tile.column("size").combine_chunks()
    for start, _, near in _near_strips(tile, min_similarity):
        row, col = np.nonzero(near[:, seeds])
        if not len(row):
            continue
        own, held = seeds[col], np.bincount(row)
        some = np.flatnonzero(held)
        offsets, at = pa.array(np.append(0, np.cumsum(held[some])).astype(np.int32)), pa.array(some + start)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[own])) for x in (classes, sizes)]
        yield pa.RecordBatch.from_arrays([vid.take(at), equal.take(at), *lists], names=["vid", "equal", "classes", "sizes"])


def neighbourhood_sums(distinct: DataFrame, weights: DataFrame, min_similarity: float) -> DataFrame:
    """(class_key, marks, sums): for each vector of a class, its sums over the
    vectors of the class with a cosine over ``min_similarity``, and itself.

    ``weights`` (class_key, vid, size, id_sum, id_squares) is a written table.
    Pairs are counted in their tiles and never become rows, so what is shuffled
    and written grows with the vectors and their copies in tiles. If weights
    have a place, too, the least of the places is added.
    """
    names, least = [*MARKS, *SUMS], ["place"] if "place" in weights.columns else []
    entries = weights.select("class_key", "vid", *marks(), F.lit(1).cast("long").alias("vectors"), *SUMS[1:], *least)
    carried = ("before", *names, *least)
    tiles = _tiles(entries.join(_prefixes(distinct, min_similarity), "vid"), ["class_key", "opcode"], min_similarity, WIDE_TILE, carried)
    schema = ", ".join(["class_key string", *(f"{c} long" for c in [*MARKS, *(f"sum_{c}" for c in names), *(["least"] if least else [])])])
    found = tiles.mapInArrow(_by_tile(min_similarity, _sums_of), schema)
    if min_similarity < 1:
        own = entries.join(distinct.select("vid"), "vid", "left_semi")
        found = found.unionByName(own.select("class_key", *MARKS, *(F.col(c).alias(f"sum_{c}") for c in names), *(F.col(c).alias("least") for c in least)))
    return found.groupBy("class_key", *MARKS).agg(*(F.sum(f"sum_{c}").alias(f"sum_{c}") for c in names), *(F.min("least").alias("least") for _ in least))


def class_holders(distinct: DataFrame, weights: DataFrame, numbers: DataFrame, min_similarity: float) -> DataFrame:
    """(vid, equal, classes, sizes): of each vector the classes that hold it,
    in several rows. ``numbers`` (marks, class, class_size) are of seeds;
    ``equal`` is the vector's size in ``weights``. No pair becomes a row."""
    entries = weights.select("class_key", "vid", "size", *marks()).join(numbers, MARKS, "left").drop(*MARKS)
    entries = entries.withColumn("class", F.coalesce("class", F.lit(-1).cast("long"))).withColumn("class_size", F.coalesce("class_size", F.lit(0).cast("long")))
    carried = ("before", "vid", "size", "class", "class_size")
    tiles = _tiles(entries.join(_prefixes(distinct, min_similarity), "vid"), ["class_key", "opcode"], min_similarity, WIDE_TILE, carried)
    found = tiles.mapInArrow(_by_tile(min_similarity, _holders_of), "vid string, equal long, classes array<long>, sizes array<long>")
    if min_similarity < 1:
        own = entries.filter("class >= 0").select("vid", F.col("size").alias("equal"), F.array("class").alias("classes"), F.array("class_size").alias("sizes"))
        found = found.unionByName(own.join(distinct.select("vid"), "vid", "left_semi"))
    return found


def class_digests(distinct: DataFrame, weights: DataFrame, min_similarity: float) -> DataFrame:
    """(class_key, size, id_sum, id_squares): a row for each different
    neighbourhood of two members or more."""
    rows = neighbourhood_sums(distinct, weights, min_similarity).drop(*MARKS).distinct().filter("sum_size > 1")
    return rows.select("class_key", *(F.col(f"sum_{c}").alias(c) for c in SUMS[1:]))


def _by_tile(min_similarity: float, work=_pairs_of):
    """Streams rows sorted by tile; holds one tile at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close():
            if held:
                whole = pa.Table.from_batches(held)
                held.clear()
                if whole.num_rows > 1:
                    done = work(whole, min_similarity)
                    yield from [done] if isinstance(done, pa.RecordBatch) else done

        for batch in batches:
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column(batch.schema.get_field_index("tile")))
            start = 0
            for end, tile in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
                if tile != now:
                    yield from close()
                    now = tile
                held.append(batch.slice(start, end - start))
                start = end
        yield from close()

    return run


def similar_vectors(distinct: DataFrame, min_similarity: float, groups: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity), a < b, of vectors with a cosine over
    ``min_similarity``. With ``groups`` (class_key, vid), of vectors that share
    a class: (class_key, a, b, similarity).

    Vectors meet in tiles of opcodes of their prefixes and of angles to those
    opcodes' axes; only pairs that are similar enough leave a tile, so what is
    shuffled is vectors and results, not candidates. A null or missing vector,
    or one of length 0, has no pair.
    """
    prefix = _prefixes(distinct, min_similarity)
    keys = ["opcode"]
    if groups is not None:
        prefix, keys = groups.select("class_key", "vid").join(prefix, "vid"), ["class_key", "opcode"]
    found = _tiles(prefix, keys, min_similarity).mapInArrow(_by_tile(min_similarity), "class_key string, a string, b string, similarity double").distinct()
    return found if groups is not None else found.drop("class_key")


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _dense_pairs(min_similarity: float):
    """(a, b, similarity) of (i, j, block, id, vec), sorted by (i, j)."""

    def pairs(rows: pa.Table, crossing: bool) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        ids, block = rows.column("id").to_numpy(), rows.column("block").to_numpy()
        x = rows.column("vec").chunk(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        length = np.sqrt((x * x).sum(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            similarity = (x @ x.T) / (length[:, None] * length[None, :])
        near = np.triu(similarity > min_similarity, 1)
        if crossing:
            near &= block[:, None] != block[None, :]
        i, j = np.nonzero(near)
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(similarity[i, j])], names=["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            i, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(i) != 0) | (np.diff(j) != 0)) + 1), len(i)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                if (i[start], j[start]) != now:
                    if held:
                        yield pairs(pa.Table.from_batches(held), now[0] != now[1])
                    now, held = (i[start], j[start]), []
                held.append(batch.slice(start, end - start))
        if held:
            yield pairs(pa.Table.from_batches(held), now[0] != now[1])

    return run


def similar_dense(rows: DataFrame, min_similarity: float, id_col: str, vec_col: str, tile: int = 1024) -> DataFrame:
    """(a, b, similarity), a < b, of dense vectors with a cosine over
    ``min_similarity``; ids are numbers, vectors of one length.

    Every two vectors are compared, as no bound on their angles prunes a low
    threshold, in tiles of about ``tile`` by ``tile`` that one matrix product
    each settles; only similar pairs leave a tile. Vectors travel once for
    every ``tile`` vectors of the table. Null vectors have no pair.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).filter("id is not null and vec is not null")
    blocks = max(1, -(-rows.count() // tile))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "vec")
    rows = rows.repartition("i", "j").sortWithinPartitions("i", "j")
    return rows.mapInArrow(_dense_pairs(min_similarity), "a long, b long, similarity double")
