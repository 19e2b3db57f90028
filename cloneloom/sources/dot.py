"""Graphs in the Graphviz text that ``operators.cfg.to_dot`` writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import ADDRESS, FUNCTION_KEY

KEY = FUNCTION_KEY

HEADER = "digraph{"

_NODE = r'([0-9]+)\[comment="\(([0-9]+),([0-9]+)\)"(?:,shape="(point|rect)")?\];'
_EDGE = r"([0-9]+)->([0-9]+)(?:\[.*\];)?"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(binary_id, function_id, dot): whole files; the path names the function."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.lit("").alias("binary_id"), F.col("_metadata.file_path").alias("function_id"), F.col("value").alias("dot"))


def parse(dots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, problems) of (key, dot).

    ``problems`` (key, problem) tells texts with another header
    (``unexpected input filetype``) or with edges between unknown nodes
    (``inconsistent data``); these have no nodes and edges.
    """
    lines = dots.select(*KEY, F.posexplode(F.split("dot", "\r?\n")).alias("line_no", "line"))
    header = lines.filter("line_no = 0")
    bad_header = header.filter(F.col("line") != HEADER).select(*KEY, F.lit("unexpected input filetype").alias("problem"))
    body = lines.filter("line_no > 0").join(bad_header, KEY, "left_anti")
    part = lambda pattern, k: F.regexp_extract("line", pattern, k)
    is_node = F.col("line").rlike(_NODE)
    nodes = body.filter(is_node).select(
        *KEY, part(_NODE, 1).cast(ADDRESS).alias("id"), part(_NODE, 2).cast(ADDRESS).alias("offset"), part(_NODE, 3).cast(ADDRESS).alias("length"),
        part(_NODE, 4).alias("shape"),
    )
    links = body.filter(~is_node & F.col("line").rlike(_EDGE)).select(*KEY, "line_no", part(_EDGE, 1).cast(ADDRESS).alias("a"), part(_EDGE, 2).cast(ADDRESS).alias("b"))
    ids = nodes.select(*KEY, "id", "offset")
    joined = links.join(ids.select(*KEY, F.col("id").alias("a"), F.col("offset").alias("src")), [*KEY, "a"], "left")
    joined = joined.join(ids.select(*KEY, F.col("id").alias("b"), F.col("offset").alias("dst")), [*KEY, "b"], "left")
    dangling = joined.filter("src is null or dst is null").select(*KEY).distinct()
    problems = bad_header.unionByName(dangling.withColumn("problem", F.lit("inconsistent data")))
    pos = F.row_number().over(Window.partitionBy(*KEY, "src").orderBy("line_no")) - 1
    edges = joined.join(dangling, KEY, "left_anti").select(*KEY, "src", "dst", pos.cast("int").alias("pos"))
    # an entry point is drawn as a point, so the root is known by its shape or,
    # for want of one, as the entry
    entry = (F.col("offset") == 0) & (F.col("length") == 0)
    any_rect = F.max((F.col("shape") == "rect").cast("int")).over(Window.partitionBy(*KEY)) == 1
    root = F.when(any_rect, F.col("shape") == "rect").otherwise(entry)
    good = nodes.join(dangling, KEY, "left_anti")
    return good.select(*KEY, "offset", "length", root.alias("is_root")), edges, problems
