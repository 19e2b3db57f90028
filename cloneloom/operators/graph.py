"""Graph operators over node and edge tables.

What joins can express is joined. What depends on the order of a visit runs as
a kernel over one function's graph, a row of arrays, many of which travel in
one Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flow
from ..model import ADDRESS, FUNCTION_KEY

KEY = FUNCTION_KEY

ARRAYS = f"nodes array<struct<offset: {ADDRESS}, length: {ADDRESS}, is_root: boolean>>, edges array<struct<src: {ADDRESS}, pos: int, dst: {ADDRESS}>>"


def as_arrays(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a function: (key, nodes, edges), both sorted."""
    n = nodes.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("offset", "length", "is_root"))).alias("nodes"))
    e = edges.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("src", "pos", "dst"))).alias("edges"))
    return n.join(e, KEY, "left")


def graph_of(nodes: list[dict], edges: list[dict] | None) -> tuple[dict[int, list[int]], int | None]:
    """(successors, root) by offset."""
    out: dict[int, list[int]] = {int(n["offset"]): [] for n in nodes}
    for e in edges or []:
        out[int(e["src"])].append(int(e["dst"]))
    return out, next((int(n["offset"]) for n in nodes if n["is_root"]), None)


def per_function(rows: DataFrame, work: Callable[[list[dict], list[dict]], list[tuple]], schema: str, types: list[pa.DataType]) -> DataFrame:
    """Run a kernel over each function's arrays; it returns rows of ``schema``
    (of plain types), to which the key is added."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                out.extend((row[KEY[0]], row[KEY[1]], *r) for r in work(row["nodes"], row["edges"] or []))
            columns = zip(*out, strict=True) if out else [()] * (len(types) + 2)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), *types], strict=True)], names=[*KEY, *names])

    return rows.select(*KEY, "nodes", "edges").mapInArrow(run, f"binary_id string, function_id string, {schema}")


VISITS = "offset long, bfs int, level int, pre int, post int, scc int, is_loop boolean, depth int"


def _visits(nodes: list[dict], edges: list[dict]) -> list[tuple]:
    graph, root = graph_of(nodes, edges)
    component = flow.components(graph, root)
    loops, depth = flow.looping(component), flow.depths(graph, root)
    pre = {n: k for k, n in enumerate(flow.preorder(graph, root))}
    post = {n: k for k, n in enumerate(flow.postorder(graph, root))}
    wide: dict[int, int] = {}
    for k, n in enumerate(flow.breadth_first(graph, root)):
        wide.setdefault(n, k)
    level = {root: 0}
    for n in wide:
        for c in graph[n]:
            level.setdefault(c, level[n] + 1)
    return [(n, wide[n], level[n], pre[n], post[n], component[n], loops[n], depth[n]) for n in pre]


def visits(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each node that its root reaches: places in breadth-first
    order, preorder and postorder, level, strongly connected component, whether
    it lies on a loop, and depth. Offsets come as strings of digits."""
    types = [pa.string(), *[pa.int32()] * 5, pa.bool_(), pa.int32()]
    work = lambda n, e: [(str(r[0]), *r[1:]) for r in _visits(n, e)]
    rows = per_function(as_arrays(nodes, edges), work, VISITS.replace("offset long", "offset string"), types)
    return rows.withColumn("offset", F.col("offset").cast(ADDRESS))


def neighbours(edges: DataFrame) -> DataFrame:
    """(key, src, neighbours): successors in order."""
    return edges.groupBy(*KEY, "src").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("neighbours"))


def sizes(nodes: DataFrame) -> DataFrame:
    """(key, n_nodes)."""
    return nodes.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_nodes"))


def predecessors(nodes: DataFrame, edges: DataFrame, reached: DataFrame) -> DataFrame:
    """(key, offset, pred): direct parents that the root reaches, null for a
    reached node without any."""
    live = edges.join(reached.select(*KEY, F.col("offset").alias("src")), [*KEY, "src"], "left_semi")
    parents = live.select(*KEY, F.col("dst").alias("offset"), F.col("src").alias("pred")).distinct()
    return reached.select(*KEY, "offset").join(parents, [*KEY, "offset"], "left")


def levels(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(key, offset, level) of reachable nodes, by joins alone.

    The frontier is joined with the edges until nothing new is reached or
    ``most`` levels are done: as many rounds as the deepest graph has levels,
    all functions at once.
    """
    from .common import written

    step = written(edges.select(*KEY, "src", "dst").distinct(), "edges")
    seen = written(nodes.filter("is_root").select(*KEY, "offset", F.lit(0).alias("level")), "level")
    frontier, level = seen, 0
    while most is None or level < most:
        level += 1
        new = frontier.withColumnRenamed("offset", "src").join(step, [*KEY, "src"]).select(*KEY, F.col("dst").alias("offset")).distinct()
        frontier = written(new.join(seen, [*KEY, "offset"], "left_anti").withColumn("level", F.lit(level)), "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def loops(components: DataFrame) -> DataFrame:
    """(key, offset, scc, is_loop) of (key, offset, scc): a component of two
    nodes or more is a loop."""
    return components.select(*KEY, "offset", "scc", (F.count(F.lit(1)).over(Window.partitionBy(*KEY, "scc")) > 1).alias("is_loop"))


def loop_exits(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(key, scc, exit, target): edges that leave a component."""
    src = components.select(*KEY, F.col("offset").alias("src"), F.col("scc").alias("src_scc"))
    dst = components.select(*KEY, F.col("offset").alias("dst"), F.col("scc").alias("dst_scc"))
    crossing = edges.join(src, [*KEY, "src"]).join(dst, [*KEY, "dst"]).filter("src_scc <> dst_scc")
    return crossing.select(*KEY, F.col("src_scc").alias("scc"), F.col("src").alias("exit"), F.col("dst").alias("target")).distinct()


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those in ``gone`` (key, src, dst); places close up."""
    left = edges.join(gone, [*KEY, "src", "dst"], "left_anti")
    pos = F.row_number().over(Window.partitionBy(*KEY, "src").orderBy("pos")) - 1
    return left.withColumn("pos", pos.cast("int"))


def to_dot(nodes: DataFrame, edges: DataFrame, directed: bool = True) -> DataFrame:
    """(key, dot): edges that the root reaches, each node's in the order of a
    depth-first visit."""
    head, arrow = ("digraph G {\n", "->") if directed else ("graph G{\n", "--")

    def work(nodes: list[dict], edges: list[dict]) -> list[tuple]:
        graph, root = graph_of(nodes, edges)
        lines, seen, stack = [], set(), [] if root is None else [root]
        while stack:
            node = stack.pop()
            if node not in seen:
                seen.add(node)
                lines += [f'"{node}"{arrow}"{child}"\n' for child in graph[node]]
                stack += graph[node]
        return [(head + "".join(lines) + "}\n",)]

    return per_function(as_arrays(nodes, edges), work, "dot string", [pa.string()])
