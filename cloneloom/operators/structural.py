"""Structural clone classes: equal streams of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, written

MEMBER = ["binary_id", "function_id", "node_id"]


def structural_key(strict: bool = False) -> Column:
    """What members of a class share; its digest, to shuffle less. Labels in
    postorder, or, if strict, the numbers of children, too."""
    return F.sha2("strict_key" if strict else "struct_key", 256)


def structurally_equal(a: Column, b: Column) -> Column:
    """Equality of strict keys: the same labels with the same children."""
    return a == b


def candidates(tree: DataFrame, min_depth: int = 3) -> DataFrame:
    """Subtrees that are deep enough."""
    return tree.filter(F.col("depth") >= min_depth)


def structural_members(tree: DataFrame, min_depth: int = 3, strict: bool = False) -> DataFrame:
    """Members (class_key, class_depth, binary_id, function_id, node_id,
    depth, basic_blocks) of classes of two subtrees or more.

    A function can be a member several times. A class's depth is that of its
    first member. Sizes are counted before the shuffle and joined back, and
    classes that hold a large share of all rows are joined without moving
    them, so that no class is gathered in one task. ``tree`` is read twice.
    """
    rows = candidates(tree, min_depth).withColumn("class_key", structural_key(strict))
    rows = rows.select("class_key", *MEMBER, "depth", "basic_blocks")
    sizes = rows.groupBy("class_key").agg(F.count(F.lit(1)).alias("size"), F.min_by("depth", F.struct(*MEMBER)).alias("class_depth"))
    several = written(sizes.filter("size > 1"), "class_sizes")
    return join_groups(rows, several, ["class_key"], "size").drop("size")
