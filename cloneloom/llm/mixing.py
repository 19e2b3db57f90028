"""Mixing sources to target weights by pivotal dependent rounding.

A source whose target is ``p`` times its words takes each of its documents
``floor(p)`` times, and once more with probability ``p - floor(p)``. The extra
copies are rounded dependently: two documents with fractional probabilities
trade words until one probability is 0 or 1, at random and in such
proportions that no document's expected copies change. As what one gains in
words the other loses, a source's words change only by the last document left.

Documents are paired inside leaves of a reduction tree; each leaf hands the
one document that is left, with its probability, to the next level. Rows with
the same id, text and source are one document with a number of rows: as many
of them as its probabilities add up to get their extra copy for sure, and what
is left over is one probability. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, rank_in_groups, salts_for, text_of, written

WORD = r"[^\x20\x09-\x0D]+"

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)

MOST_COPIES = 3

#: Documents that one leaf of the tree folds.
FAN_IN = 128

#: Size classes for each doubling of a document's words.
CLASSES_PER_DOUBLING = 4

SEED = 20

#: Sources up to which their table is broadcast.
MOST_BROADCAST = 100_000

#: Rows of one document that a task lists at a time.
LISTED = 100_000

#: ``k`` tells documents apart, ``sure`` are the extra copies so far.
DOCUMENT = "k: binary, doc_id: bigint, size: bigint, n_rows: bigint, whole: bigint, sure: bigint"

UNIT = f"struct<{DOCUMENT}, p: double, h: bigint>"

SETTLED = f"struct<{DOCUMENT}>"

FIELDS = ("k", "doc_id", "size", "n_rows", "whole")


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, share: float = 1.0) -> DataFrame:
    """Add ``target`` to one row per source of (source, source_size).

    The sources weigh ``weights`` in turn, by code point, null last. Targets
    are ``min(most * source_size, level * weight)`` with the one level at which
    they add up to ``share`` of all sizes: what resharing the excess by weight
    comes to. The sources are few against the documents; two windows over them
    give the level.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    place = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_place", place).withColumn("_w", weight).withColumn("_most", F.col("source_size").cast("double") * most)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_total", F.sum(F.col("source_size").cast("double")).over(everything) * share)
    order = Window.orderBy(F.col("_most") / F.col("_w"), "_place")
    before = F.coalesce(F.sum("_most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (F.col("_total") - before) / rest)
    fits = F.when(F.col("_level") <= F.col("_most") / F.col("_w"), F.col("_level"))
    # past the first source that isn't capped, levels only fall: the largest is it
    rows = rows.withColumn("_level", F.max(fits).over(everything))
    target = F.when(F.col("_level").isNull(), F.col("_most")).otherwise(F.least("_most", F.col("_level") * F.col("_w")))
    return rows.withColumn("target", target).drop("_place", "_w", "_most", "_total", "_level")


def _uniform(h: Column, salt: Column) -> Column:
    """In [0, 1), the same for the same hash and salt."""
    return F.pmod(F.xxhash64(h, salt, F.lit(SEED)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _settled(unit: Column, extra: Column) -> Column:
    return F.struct(*(unit[c].alias(c) for c in FIELDS), (unit["sure"] + extra).alias("sure"))


def _with_p(unit: Column, p: Column) -> Column:
    return F.struct(*(unit[c].alias(c) for c in (*FIELDS, "sure")), p.alias("p"), unit["h"].alias("h"))


def _meet(state: Column, b: Column) -> Column:
    """One step: the document left so far meets the next one."""
    a = state["left"]
    per_a = b["size"] / a["size"]
    per_b = a["size"] / b["size"]
    # a rises until it is 1 or b is 0; a falls until it is 0 or b is 1
    rise = F.least(1 - a["p"], b["p"] * per_a)
    fall = F.least(a["p"], (1 - b["p"]) * per_a)
    rises = _uniform(a["h"], b["h"]) * (rise + fall) < fall
    a_ends = F.when(rises, 1 - a["p"] <= b["p"] * per_a).otherwise(a["p"] <= (1 - b["p"]) * per_a)
    moved_b = F.when(rises, b["p"] - rise * per_b).otherwise(b["p"] + fall * per_b)
    moved_a = F.when(rises, a["p"] + rise).otherwise(a["p"] - fall)
    inside = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    # at the end of the step, the settled document has 1 if it rose, else 0
    settled = F.when(a_ends, _settled(a, F.when(rises, one).otherwise(none))).otherwise(_settled(b, F.when(rises, none).otherwise(one)))
    left = F.when(a_ends, _with_p(b, inside(moved_b))).otherwise(_with_p(a, inside(moved_a)))
    return F.struct(left.alias("left"), F.concat(state["done"], F.array(settled)).alias("done"))


def _fold(units: Column) -> Column:
    """Settle all but one of a leaf's documents, the largest first."""
    first = F.element_at(units, 1)
    none = F.array().cast(f"array<{SETTLED}>")
    start = F.struct(first.alias("left"), none.alias("done"))
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), start, _meet)


def _leaf(rows: DataFrame, keys: list[str]) -> DataFrame:
    falling = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("unit.size")).alias("s"), "unit.h", "unit")), True), lambda x: x["unit"])
    return rows.groupBy(*keys).agg(_fold(falling).alias("f"))


def rounded(units: DataFrame) -> DataFrame:
    """Documents of (src int, unit struct) with fractional probabilities, with
    one more ``sure`` copy where that came up.

    Levels: hash leaves inside (source, size class) until each class has one
    document left, then the classes of a source, then the last document by its
    probability. A source's leaves are many, so a hot source is spread.
    """
    size_class = F.floor(F.log2(F.col("unit.size").cast("double")) * CLASSES_PER_DOUBLING).cast("int")
    units = units.withColumn("class", size_class)
    most = units.groupBy("src", "class").count().agg(F.max("count")).first()[0] or 0
    leaves = max(1, -(-most // (FAN_IN // 2)))
    level = units.withColumn("leaf", F.pmod(F.col("unit.h"), F.lit(leaves)))
    done: list[DataFrame] = []

    def settle(rows: DataFrame, keys: list[str]) -> DataFrame:
        folded = written(_leaf(rows, keys), "leaves")
        done.append(folded.select("src", F.explode("f.done").alias("d")).select("src", "d.*"))
        return folded.select(*keys, F.col("f.left").alias("unit"))

    while True:
        level = settle(level, ["src", "class", "leaf"])
        if leaves == 1:
            break
        leaves = -(-leaves // FAN_IN)
        level = level.withColumn("leaf", F.pmod("leaf", F.lit(leaves)))
    level = settle(level.select("src", "unit"), ["src"])
    last = F.when(_uniform(F.col("unit.h"), F.lit(-1)) < F.col("unit.p"), 1).otherwise(0)
    out = level.select("src", *(F.col(f"unit.{c}") for c in FIELDS), (F.col("unit.sure") + last).cast("long").alias("sure"))
    for d in done:
        out = out.unionByName(d)
    return out


def _key(id_col: str, text_col: str, source_col: str) -> Column:
    """256 bits of a row's id, source and text."""
    part = lambda c: F.coalesce(F.concat(F.lit("+"), F.sha2(F.col(c).cast("string"), 256)), F.lit("-"))
    return F.unhex(F.sha2(F.concat(part(id_col), part(source_col), F.sha2(text_of(text_col), 256)), 256))


def _taken(docs: DataFrame, weights: tuple[int, ...], most: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(k, doc_id, size, n_rows, whole, sure, source_size, target), one row
    for all rows with the same id, source and text: each is taken ``whole``
    times, and ``sure`` of them once more."""
    sized = docs.select(
        _key(id_col, text_col, source_col).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_of(text_col)).alias("size")
    )
    rows = sized.groupBy("k").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count(F.lit(1)).alias("n_rows"))
    rows = written(rows, "sizes")
    sources = targets(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size")), weights, most)
    sources = written(sources.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")).cast("int")), "sources")
    # one row a source: broadcast while that is small, joined by key beyond it
    sources = F.broadcast(sources) if sources.count() <= MOST_BROADCAST else sources
    named = sources.withColumnRenamed("source", "_source")
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("_source")))
    per = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(per).cast("long")).withColumn("extra", (per - F.floor(per)) * F.col("n_rows"))
    rows = rows.withColumn("sure", F.floor("extra").cast("long")).withColumn("p", F.col("extra") - F.col("sure"))
    settled = rows.filter("p <= 0").select("src", *FIELDS, "sure")
    unit = F.struct(*FIELDS, "sure", "p", F.xxhash64("k").alias("h")).cast(UNIT)
    units = written(rows.filter("p > 0").select("src", unit.alias("unit")), "units")
    out = settled if units.isEmpty() else settled.unionByName(rounded(units))
    return out.join(sources.select("src", "source_size", "target"), "src").drop("src")


def _listed(rows: DataFrame) -> DataFrame:
    """A row for each of ``n_rows``, with its place ``nth``. Documents of very
    many rows are cut into parts that are dealt over the cluster."""
    few, many = rows.filter(F.col("n_rows") <= LISTED), rows.filter(F.col("n_rows") > LISTED)
    low = few.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1)))
    start = many.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1, F.lit(LISTED).cast("long")))).repartition("k", "_from")
    high = start.withColumn("nth", F.explode(F.sequence(F.col("_from"), F.least(F.col("n_rows"), F.col("_from") + LISTED) - 1))).drop("_from")
    return low.unionByName(high)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    ``taken`` is ``size`` times ``copies``. A null or empty text, or one without
    a word, is taken 0 times; a very long one counts with all its words. Null
    sources are one source, null ids are ids like others. Random choices depend
    on ids, sources and texts only, so reruns agree; ties don't arise, as keys
    differ. Repeated rows have a row each, and share their copies out. Other
    columns are ignored. An empty table stays empty. Sources are told apart in
    windows over all of them, so there should be millions at most.
    """
    rows = _listed(written(_taken(docs, weights, most, id_col, text_col, source_col), "taken"))
    copies = (F.col("whole") + F.when(F.col("nth") < F.col("sure"), 1).otherwise(0)).cast("int")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` takes it, with
    all its columns, whatever their names.

    Of rows with the same id, source and text the first of some order get the
    copies that not all can have. Nulls, empty and long texts as in ``mix``; an
    empty table stays empty.
    """
    taken = written(_taken(docs, weights, most, id_col, text_col, source_col).select("k", "n_rows", "whole", "sure"), "taken")
    rows = docs.select(_key(id_col, text_col, source_col).alias("k"), F.struct("*").alias("row"))
    several = taken.filter("n_rows > 1")
    # what is taken grows with the documents, so it isn't for broadcasting
    once = rows.join(taken.filter("n_rows = 1 and whole + sure > 0").hint("merge"), "k").withColumn("copies", F.col("whole") + F.col("sure"))
    out = once.select("row", "copies")
    if not several.isEmpty():
        n_rows = several.agg(F.sum("n_rows")).first()[0]
        again = written(join_groups(rows, several, ["k"], "n_rows", n_rows, "merge"), "repeated_rows")
        nth = rank_in_groups(again, ["k"], ["row"], salts_for(n_rows), "nth")
        copies = F.col("whole") + F.when(F.col("nth") < F.col("sure"), 1).otherwise(0)
        out = out.unionByName(nth.select("row", copies.alias("copies")).filter("copies > 0"))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
