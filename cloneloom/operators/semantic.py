"""Semantic clone classes: the neighbourhood of each function.

Classes may overlap; they are no connected components. Functions with the
same vector have the same neighbourhood, so neighbourhoods are found and
compared between distinct vectors and members are listed last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MULTISET, join_groups, multiset, numbered, written
from .vectors import MARKS, SUMS, class_digests, class_holders, distinct_vectors, neighbourhood_sums, similar_vectors

#: Functions with one vector that a task lists for its classes.
SHARE = 4096


def neighbourhoods(pairs: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b) both ways, and each of ``nodes`` (keys, vid) with itself."""
    there = pairs.select(*keys, "a", "b")
    back = pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))
    own = nodes.select(*keys, F.col("vid").alias("a"), F.col("vid").alias("b"))
    return there.unionByName(back).unionByName(own)


def distinct_neighbourhoods(around: DataFrame, keys: list[str]) -> DataFrame:
    """Of seeds with the same neighbours in a class, keep one."""
    marks = around.groupBy(*keys, "a").agg(*multiset("b"))
    kept = marks.groupBy(*keys, *MULTISET).agg(F.min("a").alias("a"))
    return around.join(kept.select(*keys, "a"), [*keys, "a"], "left_semi")


def semantic_members(vecs: DataFrame, min_similarity: float = 0.99) -> DataFrame:
    """Members (class_key, binary_id, function_id) of all classes of two or
    more; ``vecs`` as ``vectors`` gives it."""
    vecs = written(vecs, "vectors")
    distinct = written(distinct_vectors(vecs), "distinct_vectors")
    pairs = written(similar_vectors(distinct, min_similarity), "pairs")
    if min_similarity >= 1:
        distinct = distinct.limit(0)
    around = distinct_neighbourhoods(written(neighbourhoods(pairs, distinct, []), "around"), [])
    # a class's size needs the numbers of equal vectors alone
    equal = vecs.groupBy(F.col("vid").alias("b")).agg(F.count(F.lit(1)).alias("equal"))
    several = around.join(equal, "b").groupBy("a").agg(F.sum("equal").alias("size")).filter("size > 1").select("a")
    around = written(around.join(several, "a", "left_semi"), "classes")
    members = around.join(vecs.select(F.col("vid").alias("b"), "binary_id", "function_id"), "b")
    return members.select(F.col("a").alias("class_key"), "binary_id", "function_id")


def semantic_digests(vecs: DataFrame, value: Column, min_similarity: float = 0.99) -> DataFrame:
    """(size, id_sum, id_squares) of the classes of ``semantic_members``, the
    sums being those of ``value``; neither pairs nor members are listed."""
    vecs = written(vecs.withColumn("value", value), "vectors")
    distinct = written(distinct_vectors(vecs), "distinct_vectors")
    weights = vecs.groupBy(F.lit("").alias("class_key"), "vid").agg(F.count(F.lit(1)).alias("size"), F.sum("value").alias("id_sum"), F.sum(F.col("value") * F.col("value")).alias("id_squares"))
    return class_digests(distinct, written(weights, "weights"), min_similarity).drop("class_key")


class Classes:
    """The classes of ``semantic_members``, as sums; their members are listed
    last, straight into the result, so that what is written and shuffled
    before grows with neither pairs nor members."""

    def __init__(self, vecs: DataFrame, min_similarity: float = 0.99):
        self.least = min_similarity
        self.vecs = written(vecs.select("binary_id", "function_id", "vid", "vec", "norm2"), "vectors")
        self.distinct = written(distinct_vectors(self.vecs), "distinct_vectors")
        nothing = F.lit(0).cast("long")
        weights = self.vecs.groupBy("vid").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct("binary_id", "function_id")).alias("first"))
        weights = numbered(weights.select(F.lit("").alias("class_key"), "vid", "size", "first", nothing.alias("id_sum"), nothing.alias("id_squares")), [F.col("first"), F.col("vid")], "place")
        self.weights = written(weights.drop("first"), "weights")
        sums = neighbourhood_sums(self.distinct, self.weights, min_similarity).filter("sum_size > 1")
        sets = sums.groupBy(*(f"sum_{c}" for c in [*MARKS, *SUMS[:2]]), "least").agg(F.min(F.struct(*MARKS)).alias("class_key"))
        #: (class_key, size, first_member, class_depth); first_member is the
        #: place of its vector among all in the order of their least members.
        self.found = written(sets.select("class_key", F.col("sum_size").alias("size"), F.col("least").alias("first_member"), F.lit(0).alias("class_depth")), "classes")

    def members(self, numbers: DataFrame) -> DataFrame:
        """(clone_class_id, class_depth, size, binary_id, function_id);
        ``numbers`` is ``found`` with clone_class_id."""
        numbers = written(numbers.select("class_key.*", F.col("clone_class_id").alias("class"), F.col("size").alias("class_size")), "class_numbers")
        shares = F.ceil(F.col("equal") / SHARE).cast("int")
        holders = class_holders(self.distinct, self.weights, numbers, self.least)
        holders = holders.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("equal")
        equal = self.weights.select("vid", F.col("size").alias("equal"))
        own = join_groups(self.vecs.select("binary_id", "function_id", "vid"), equal, ["vid"], "equal")
        own = own.withColumn("share", F.pmod(F.xxhash64("binary_id", "function_id"), shares).cast("int")).drop("equal")
        rows = holders.join(own, ["vid", "share"]).select("binary_id", "function_id", F.explode(F.arrays_zip("classes", "sizes")).alias("x"))
        return rows.select(F.col("x.classes").alias("clone_class_id"), F.lit(0).alias("class_depth"), F.col("x.sizes").alias("size"), "binary_id", "function_id")
