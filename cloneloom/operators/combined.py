"""Structural classes refined by similarity inside each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, MULTISET, multiset, written
from .semantic import SHARE, distinct_neighbourhoods, neighbourhoods
from .structural import MEMBER
from .vectors import class_digests, distinct_vectors, similar_vectors


def combined_members(members: DataFrame, vecs: DataFrame, min_similarity: float = 0.99) -> DataFrame:
    """Members of the semantic classes inside structural ones.

    The vector is that of the whole function, even of an inner subtree.
    Functions without a vector drop out. Pairs are sought between distinct
    vectors inside each class.
    """
    vecs = written(vecs, "vectors")
    distinct = written(distinct_vectors(vecs), "distinct_vectors")
    rows = members.drop("class_depth").join(vecs.select("binary_id", "function_id", "vid"), ["binary_id", "function_id"])
    rows = written(rows.join(distinct.select("vid"), "vid", "left_semi"), "members")
    held = written(rows.select("class_key", "vid").distinct(), "class_vectors")
    inside = written(similar_vectors(distinct, min_similarity, held), "pairs")
    own = held.limit(0) if min_similarity >= 1 else held
    around = distinct_neighbourhoods(written(neighbourhoods(inside, own, ["class_key"]), "around"), ["class_key"])
    # sizes and depths need one row for each vector of a class, not its members
    first = F.struct(*MEMBER, "depth")
    per = rows.groupBy("class_key", F.col("vid").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("first"))
    sizes = around.join(per, ["class_key", "b"]).groupBy("class_key", "a").agg(F.sum("n").alias("size"), F.min("first").alias("first"))
    sizes = sizes.filter("size > 1").select("class_key", "a", F.col("first.depth").alias("class_depth"))
    name = F.sha2(F.concat_ws("/", "class_key", "a"), 256)
    listed = written(around.join(sizes, ["class_key", "a"]).select("class_key", "b", name.alias("name"), "class_depth"), "classes")
    found = listed.join(rows.withColumnRenamed("vid", "b"), ["class_key", "b"])
    return found.select(F.col("name").alias("class_key"), *[c for c in rows.columns if c not in ("class_key", "vid")], "class_depth")


def combined_digests(members: DataFrame, vecs: DataFrame, value: Column, min_similarity: float = 0.99) -> DataFrame:
    """(class_key, size, id_sum, id_squares) of the classes of
    ``combined_members``, the sums being those of ``value``, with the structural
    class as ``class_key``; neither pairs nor members are listed."""
    vecs = written(vecs, "vectors")
    distinct = written(distinct_vectors(vecs), "distinct_vectors")
    rows = members.withColumn("value", value).join(vecs.select("binary_id", "function_id", "vid"), ["binary_id", "function_id"])
    weights = rows.groupBy("class_key", "vid").agg(F.count(F.lit(1)).alias("size"), F.sum("value").alias("id_sum"), F.sum(F.col("value") * F.col("value")).alias("id_squares"))
    return class_digests(distinct, written(weights, "weights"), min_similarity)


class Classes:
    """The classes of ``combined_members``, as sums over the vectors of their
    structural classes; their members are listed last, straight into the
    result, and aren't written or shuffled before.

    ``members`` have the ``name`` that their binary goes by in the result;
    ``vecs`` is a written table. Members are made twice, the first time
    without what only the result needs.
    """

    def __init__(self, members: DataFrame, vecs: DataFrame, min_similarity: float = 0.99):
        distinct = written(distinct_vectors(vecs), "distinct_vectors")
        # a row for each function, which a file's size doesn't tell: never broadcast
        own = vecs.filter("norm2 > 0").select("binary_id", "function_id", F.col("vid").alias("b")).hint("merge")
        self.rows = members.drop("class_depth").join(own, ["binary_id", "function_id"])
        # sums, first members and depths need one row for each vector of a class
        firsts = [F.min(F.struct(*MEMBER, "depth")).alias("first"), F.min(F.struct(F.col("name").alias("binary_id"), "function_id")).alias("first_member")]
        self.per = written(self.rows.groupBy("class_key", "b").agg(*multiset("name", "function_id"), *firsts), "class_vectors")
        held = self.per.select("class_key", F.col("b").alias("vid"))
        inside = written(similar_vectors(distinct, min_similarity, held), "pairs")
        around = written(neighbourhoods(inside, held.limit(0) if min_similarity >= 1 else held, ["class_key"]), "around")
        self.around = written(distinct_neighbourhoods(around, ["class_key"]), "neighbourhoods")
        sums = [F.sum(c).alias(c) for c in MULTISET]
        found = self.around.join(self.per, ["class_key", "b"]).groupBy("class_key", "a").agg(*sums, F.min("first").alias("first"), F.min("first_member").alias("first_member"))
        found = found.filter("_members > 1").withColumnRenamed("class_key", "structure")
        name = F.sha2(F.concat_ws("/", "structure", "a"), 256).alias("class_key")
        #: (structure, a, class_key, class_depth, size, first_member and the sums)
        self.found = written(found.select("structure", "a", name, F.col("first.depth").alias("class_depth"), F.col("_members").alias("size"), "first_member", *MULTISET), "classes")

    def members(self, numbers: DataFrame) -> DataFrame:
        """Members of the classes in ``numbers``, which are rows of ``found``
        with clone_class_id. Vectors with a large share of all members are
        dealt into parts that meet their classes in different tasks."""
        columns = ["class_key", "class_depth", "clone_class_id", "size"]
        numbers = written(numbers.select(F.col("structure").alias("_structure"), "a", *columns), "class_numbers")
        least = max(SHARE, int((self.per.agg(F.sum("_members")).first()[0] or 0) * HOT_SHARE))
        shares = F.when(F.col("_members") > least, F.ceil(F.col("_members") / SHARE)).otherwise(1).cast("int").alias("shares")
        per = self.per.select(F.col("class_key").alias("_structure"), "b", shares)
        holders = self.around.withColumnRenamed("class_key", "_structure").join(numbers, ["_structure", "a"]).join(per, ["_structure", "b"])
        holders = holders.select("_structure", "b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), *columns)
        rows = self.rows.withColumnRenamed("class_key", "_structure").join(F.broadcast(per.filter("shares > 1")), ["_structure", "b"], "left")
        rows = rows.withColumn("share", F.coalesce(F.pmod(F.xxhash64(*MEMBER), "shares"), F.lit(0)).cast("int"))
        listed = holders.join(rows, ["_structure", "b", "share"])
        kept = [c for c in self.rows.columns if c not in ("class_key", "b", "binary_id", "name")]
        return listed.select("class_key", F.col("name").alias("binary_id"), *kept, *columns[1:])


def deepest_classes(found: DataFrame) -> DataFrame:
    """``results.deepest_only`` of the classes in ``Classes.found``."""
    last = F.max(F.struct("class_depth", "class_key", *(c for c in found.columns if c not in ("class_depth", "class_key", *MULTISET))))
    return found.groupBy(*MULTISET).agg(last.alias("x")).select("x.*")
