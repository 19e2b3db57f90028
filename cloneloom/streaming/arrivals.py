"""Structured Streaming: newly arrived functions against a known corpus.

The structure of each arriving function is reduced in the stream and joined
with the keys of the known subtrees, a static table; matches are written by
micro-batch, so a batch that is run again replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import structural, structure
from ..operators.structural import MEMBER


def known_keys(tree: DataFrame, min_depth: int = 3) -> DataFrame:
    """(class_key, known): subtrees of the known corpus by key."""
    rows = structural.candidates(tree, min_depth).withColumn("class_key", structural.structural_key())
    return rows.groupBy("class_key").agg(F.count(F.lit(1)).alias("known"))


def matches(nodes: DataFrame, edges: DataFrame, known: DataFrame, min_depth: int = 3) -> DataFrame:
    """Subtrees of arriving functions that the corpus knows."""
    tree = structure.tree_nodes(structure.reduce_functions(nodes, edges))
    rows = structural.candidates(tree, min_depth).withColumn("class_key", structural.structural_key())
    return rows.join(known, "class_key").select("class_key", *MEMBER, "depth", "known")


def watch(arrivals: DataFrame, known: DataFrame, path: str, checkpoint: str, min_depth: int = 3) -> StreamingQuery:
    """Start the stream. ``arrivals`` has a row for each function with its
    graph in arrays ``nodes`` and ``edges``."""
    from ..operators.graph import KEY

    def batch(rows: DataFrame, number: int) -> None:
        nodes = rows.select(*KEY, F.explode("nodes").alias("n")).select(*KEY, "n.*")
        edges = rows.select(*KEY, F.explode("edges").alias("e")).select(*KEY, "e.*")
        found = matches(nodes, edges, known, min_depth)
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
