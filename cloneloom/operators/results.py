"""What is made of clone classes: filter, order, numbers and reports.

Classes are held as rows of members (class_key, class_depth, binary_id,
function_id, ...), never as lists, so a class can be of any size.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import block_list
from ..functions.statements import untag
from .common import MULTISET, join_groups, multiset, numbered, written

# Names of orders, columns of the CSV report, lines of the text
# report.
SORTS = ("none", "depth-asc", "depth-desc", "size-asc", "size-desc")
CSV_COLUMNS = ("arch", "bits", "binary", "function", "clone_class_id", "class_depth", "basic_blocks")
CLASS_LINE, LAST_LINE, SUMMARY_LINE = "----- CLONE CLASS ({}) -----", "----------------------------", "Classes: {} Clones: {}"


def with_depth(members: DataFrame) -> DataFrame:
    """Semantic classes have no structures; their depth is 0."""
    return members if "class_depth" in members.columns else members.withColumn("class_depth", F.lit(0))


def deepest_only(members: DataFrame) -> DataFrame:
    """Of classes with the same functions (repeats count), keep the deepest."""
    rows = with_depth(members)
    marks = rows.groupBy("class_key", "class_depth").agg(*multiset("binary_id", "function_id"))
    kept = marks.groupBy(*MULTISET).agg(F.max_by("class_key", F.struct("class_depth", "class_key")).alias("class_key"))
    return rows.join(kept.select("class_key"), "class_key", "left_semi")


def _order(sort: str) -> list[Column]:
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {', '.join(SORTS)}")
    first = {"none": [], "depth-asc": [F.asc("class_depth")], "depth-desc": [F.desc("class_depth")], "size-asc": [F.asc("size")], "size-desc": [F.desc("size")]}[sort]
    return [*first, F.asc("first_member"), F.asc("class_depth"), F.asc("size"), F.asc("class_key")]


def class_numbers(classes: DataFrame, sort: str = "none") -> DataFrame:
    """Add clone_class_id (from 0, in the order) to rows of classes."""
    return numbered(classes, _order(sort), "clone_class_id")


def ranked(members: DataFrame, sort: str = "none") -> DataFrame:
    """Add clone_class_id (from 0, in the order) and size to each member. Ties
    are settled by the least member."""
    rows = written(with_depth(members), "members")
    classes = rows.groupBy("class_key").agg(
        F.first("class_depth").alias("class_depth"), F.count(F.lit(1)).alias("size"), F.min(F.struct("binary_id", "function_id")).alias("first_member")
    )
    numbers = written(class_numbers(classes, sort).select("class_key", "clone_class_id", "size"), "class_numbers")
    return join_groups(rows, numbers, ["class_key"], "size")


def summary(members: DataFrame) -> DataFrame:
    """One row: classes and clones."""
    return members.agg(F.countDistinct("class_key").alias("classes"), F.count(F.lit(1)).alias("clones"))


def csv_rows(numbered_members: DataFrame, basic_blocks: bool = False) -> DataFrame:
    """Rows of the CSV report; ``binary_id`` is a tagged name."""
    arch, bits, path = untag(F.col("binary_id"))
    has = "basic_blocks" in numbered_members.columns
    values = [arch, bits, path, F.col("function_id"), F.col("clone_class_id"), F.col("class_depth"), block_list(F.col("basic_blocks")) if has else F.lit(None).cast("string")]
    named = [v.alias(name) for v, name in zip(values, CSV_COLUMNS, strict=True)]
    return numbered_members.select(*(named if basic_blocks else named[:-1]))


def write_csv(numbered_members: DataFrame, path: str, basic_blocks: bool = False) -> None:
    rows = csv_rows(numbered_members, basic_blocks)
    rows.repartitionByRange("clone_class_id").sortWithinPartitions("clone_class_id", "binary", "function").write.option("header", True).csv(path)


def csv_lines(numbered_members: DataFrame, basic_blocks: bool = False) -> Iterator[str]:
    """Lines of the CSV report, streamed in order to the driver."""
    rows = csv_rows(numbered_members, basic_blocks)
    out = io.StringIO()
    write = csv.writer(out, lineterminator="")

    def line(values) -> str:
        out.seek(0)
        out.truncate()
        write.writerow(values)
        return out.getvalue()

    yield line(rows.columns)
    for r in rows.orderBy("clone_class_id", "binary", "function").toLocalIterator(prefetchPartitions=True):
        yield line(r)


def text_lines(numbered_members: DataFrame, basic_blocks: bool = False) -> Iterator[str]:
    """Lines of the text report, streamed in order to the driver."""
    rows = numbered_members
    blocks = block_list(F.col("basic_blocks")) if "basic_blocks" in rows.columns else F.lit(None).cast("string")
    order = ["clone_class_id", "binary_id", "function_id", *(["node_id"] if "node_id" in rows.columns else [])]
    rows = rows.select(*order, "class_depth", blocks.alias("listed")).orderBy(*order)
    now, classes, clones = None, 0, 0
    for r in rows.toLocalIterator(prefetchPartitions=True):
        if r["clone_class_id"] != now:
            now = r["clone_class_id"]
            classes += 1
            yield CLASS_LINE.format(r["class_depth"])
        clones += 1
        if not basic_blocks:
            yield f"{r['binary_id']} :: {r['function_id']}"
        elif r["listed"] is not None:
            yield f"{r['binary_id']} :: {r['function_id']} [{r['listed']}]"
    yield LAST_LINE
    yield SUMMARY_LINE.format(classes, clones)


def architectures_differ(binaries: DataFrame) -> DataFrame:
    """One row: whether there are several (arch, bits)."""
    return binaries.agg((F.countDistinct(F.struct("arch", "bits")) > 1).alias("differ"))
