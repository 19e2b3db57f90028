"""Control-flow graphs from statements or from block and edge tables.

Everything is a window over one function or an equi-join on (function,
offset), so functions are dealt over the cluster by their key alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import statements as S
from ..functions.blocks import address, kind
from ..model import ADDRESS, ENTRY, FUNCTION_KEY, SINK
from .common import written

KEY = FUNCTION_KEY


def jumps(statements: DataFrame, arch: Column) -> DataFrame:
    """Add jump, target and inside (the target lies between the function's
    first and last statement) to statements."""
    rows = statements.withColumn("jump", S.jump(arch, S.mnemonic(F.col("instruction"))))
    rows = rows.withColumn("target", F.when(F.col("jump").isin(S.JUMP_COND, S.JUMP_UNCOND), S.number(S.arguments(F.col("instruction")))))
    whole = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_low", F.first("offset").over(whole)).withColumn("_high", F.last("offset").over(whole))
    inside = F.coalesce(F.col("target").between(F.col("_low"), F.col("_high")), F.lit(False))
    return rows.withColumn("inside", inside).drop("_low", "_high")


def leaders(jumped: DataFrame, outside_targets: bool = False) -> DataFrame:
    """(key, offset) at which blocks start: the first statement, those after a
    jump or return, and targets inside. ``outside_targets`` adds conditional
    targets that lie outside, as blocks of their own."""
    before = F.lag("jump").over(Window.partitionBy(*KEY).orderBy("pos"))
    starts = jumped.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_before") != S.NO_JUMP)).select(*KEY, "offset")
    wanted = F.col("inside") | ((F.col("jump") == S.JUMP_COND) & F.lit(outside_targets))
    targets = jumped.filter(F.col("target").isNotNull() & wanted).select(*KEY, F.col("target").alias("offset"))
    return starts.unionByName(targets).distinct()


def bare_blocks(leader: DataFrame, ends: DataFrame) -> DataFrame:
    """(key, offset, length, next): a block goes on to the next leader, the
    last one to the function's end; ``ends`` is (key, fn_end)."""
    after = F.lead("offset").over(Window.partitionBy(*KEY).orderBy("offset"))
    rows = leader.withColumn("next", after).join(ends, KEY)
    return rows.withColumn("length", (F.coalesce("next", "fn_end") - F.col("offset")).cast(ADDRESS)).drop("fn_end")


def bare_edges(jumped: DataFrame, blocks: DataFrame) -> DataFrame:
    """(key, src, dst) of jumps and of falling through.

    A statement belongs to the last block that starts at it or before. A
    conditional jump leads to the block after its own and to its target; a
    block without a jump or return leads to the next one.
    """
    marks = blocks.select(*KEY, "offset", F.lit(0).alias("rank"), F.col("offset").alias("block"), "next", F.lit(None).cast("string").alias("jump"), F.lit(None).cast(ADDRESS).alias("target"), F.lit(False).alias("inside"))
    ends = jumped.filter(F.col("jump") != S.NO_JUMP)
    ends = ends.select(*KEY, "offset", F.lit(1).alias("rank"), F.lit(None).cast(ADDRESS).alias("block"), F.lit(None).cast(ADDRESS).alias("next"), "jump", "target", "inside")
    so_far = Window.partitionBy(*KEY).orderBy("offset", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = F.last(F.when(F.col("rank") == 0, F.struct("block", "next")), ignorenulls=True).over(so_far)
    placed = marks.unionByName(ends).withColumn("held", held).filter("rank = 1").select(*KEY, "held.block", "held.next", "jump", "target", "inside")
    straight = blocks.join(placed.select(*KEY, F.col("block").alias("offset")).distinct(), [*KEY, "offset"], "left_anti")
    straight = straight.filter(F.col("next").isNotNull()).select(*KEY, F.col("offset").alias("src"), F.col("next").alias("dst"))
    taken = placed.filter("inside").select(*KEY, F.col("block").alias("src"), F.col("target").alias("dst"))
    passed = placed.filter(F.col("inside") & (F.col("jump") == S.JUMP_COND) & F.col("next").isNotNull()).select(*KEY, F.col("block").alias("src"), F.col("next").alias("dst"))
    return straight.unionByName(taken).unionByName(passed).distinct()


def inferred_roots(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, root): the lowest block that no edge leads to, else the lowest."""
    led_to = edges.select(*KEY, F.col("dst").alias("offset"), F.lit(True).alias("_led")).distinct()
    rows = blocks.select(*KEY, "offset").join(led_to, [*KEY, "offset"], "left")
    free = F.min(F.when(F.col("_led").isNull(), F.col("offset")))
    return rows.groupBy(*KEY).agg(F.coalesce(free, F.min("offset")).alias("root"))


def from_bare(blocks: DataFrame, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graphs. Edges to or from unknown blocks go; the rest
    are distinct and ordered by where they lead. The root is the block at
    ``root`` (0 if null), else the lowest."""
    known = blocks.select(*KEY, "offset").distinct()
    kept = edges.select(*KEY, "src", "dst").distinct()
    kept = kept.join(known.withColumnRenamed("offset", "src"), [*KEY, "src"], "left_semi").join(known.withColumnRenamed("offset", "dst"), [*KEY, "dst"], "left_semi")
    pos = F.row_number().over(Window.partitionBy(*KEY, "src").orderBy("dst")) - 1
    kept = kept.select(*KEY, "src", "dst", pos.cast("int").alias("pos"))
    whole = Window.partitionBy(*KEY)
    at_root = F.col("offset") == F.coalesce("root", address(0))
    rows = blocks.select(*KEY, "offset", "length").join(roots, KEY, "left")
    rows = rows.withColumn("_root", F.coalesce(F.min(F.when(at_root, F.col("offset"))).over(whole), F.min("offset").over(whole)))
    return rows.select(*KEY, "offset", "length", (F.col("offset") == F.col("_root")).alias("is_root")), kept


def gathered(blocks: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """One row a function with a block: (key, blocks, edges, roots), as they
    are. All three meet in one shuffle; ``structure.bare_cfg`` does what
    ``from_bare`` does by joins."""
    held = {"blocks": F.struct("offset", "length"), "edges": F.struct("src", "dst"), "roots": F.coalesce("root", address(0)).alias("root")}
    types = {"blocks": f"struct<offset: {ADDRESS}, length: {ADDRESS}>", "edges": f"struct<src: {ADDRESS}, dst: {ADDRESS}>", "roots": ADDRESS}
    rows = None
    for name, table in (("blocks", blocks), ("edges", edges), ("roots", roots)):
        part = table.select(*KEY, *((held[n] if n == name else F.lit(None)).cast(types[n]).alias(n) for n in types))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(*KEY).agg(*(F.collect_list(n).alias(n) for n in types)).filter(F.size("blocks") > 0)


def from_statements(statements: DataFrame, ends: DataFrame, arch: Column, outside_targets: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the graphs of statements.

    Jumps, blocks and edges are each read by several of the steps after them,
    so they are written once instead of being windowed again for each.
    """
    jumped = written(jumps(statements, arch).select(*KEY, "pos", "offset", "jump", "target", "inside"), "jumps")
    blocks = written(bare_blocks(leaders(jumped, outside_targets), ends), "blocks")
    edges = written(bare_edges(jumped, blocks), "edges")
    return from_bare(blocks, edges, inferred_roots(blocks, edges))


def successor(edges: DataFrame, pos: int) -> DataFrame:
    """(key, src, dst) of successors at a place: 0 follows, 1 is taken if a
    condition holds."""
    return edges.filter(F.col("pos") == pos).select(*KEY, "src", "dst")


def add_sink(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks without successors lead to one sink, where there are several."""
    leaves = nodes.join(edges.select(*KEY, F.col("src").alias("offset")).distinct(), [*KEY, "offset"], "left_anti")
    several = leaves.groupBy(*KEY).count().filter("count > 1").select(*KEY)
    leaves = leaves.join(several, KEY, "left_semi")
    new_edges = leaves.select(*KEY, F.col("offset").alias("src"), address(SINK).alias("dst"), F.lit(0).alias("pos"))
    new_nodes = several.select(*KEY, address(SINK).alias("offset"), address(0).alias("length"), F.lit(False).alias("is_root"))
    return written(nodes.unionByName(new_nodes), "nodes"), written(edges.unionByName(new_edges), "edges")


def add_entry_point(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An entry of its own leads to the root, where an edge leads to that."""
    roots = nodes.filter("is_root").select(*KEY, "offset")
    led_to = roots.join(edges.select(*KEY, F.col("dst").alias("offset")), [*KEY, "offset"], "left_semi")
    entry = led_to.select(*KEY, address(ENTRY).alias("offset"), address(0).alias("length"), F.lit(True).alias("is_root"))
    moved = nodes.join(led_to.select(*KEY, F.lit(True).alias("_moved")), KEY, "left")
    moved = moved.withColumn("is_root", F.col("is_root") & F.col("_moved").isNull()).drop("_moved")
    new_edges = led_to.select(*KEY, address(ENTRY).alias("src"), F.col("offset").alias("dst"), F.lit(0).alias("pos"))
    return written(moved.unionByName(entry), "nodes"), written(edges.unionByName(new_edges), "edges")


# The graph's, nodes' and edges' attributes, and colours of edges:
# the only one or one of many, the one that follows, the one that is taken.
DOT_HEAD = 'digraph{\ngraph[bgcolor=azure,fontsize=8,splines="ortho"];\nnode[fillcolor=gray,style=filled,shape=box];\nedge[arrowhead=normal];\n\n'
DOT_COLOURS = ("dodgerblue", "crimson", "forestgreen")


def to_dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, dot): one Graphviz text a function, its lines in order."""
    what = kind(F.col("offset"), F.col("length"))
    shape = F.when(what != "real", ',shape="point"').when(F.col("is_root"), ',shape="rect"').otherwise("")
    line = F.format_string('%s[comment="(%s,%s)"%s];', F.col("offset").cast("string"), F.col("offset").cast("string"), F.col("length").cast("string"), shape)
    node_text = nodes.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("offset", line.alias("line")))).alias("lines"))
    out = F.count(F.lit(1)).over(Window.partitionBy(*KEY, "src"))
    colour = F.when(out != 2, DOT_COLOURS[0]).when(F.col("pos") == 0, DOT_COLOURS[1]).otherwise(DOT_COLOURS[2])
    line = F.format_string('%s->%s[color="%s"];', F.col("src").cast("string"), F.col("dst").cast("string"), colour)
    drawn = edges.withColumn("line", line)
    edge_text = drawn.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("src", "pos", "line"))).alias("edge_lines"))
    joined = lambda c: F.concat_ws("\n", F.transform(c, lambda x: x["line"]))
    rows = node_text.join(edge_text, KEY, "left")
    return rows.select(*KEY, F.concat(F.lit(DOT_HEAD), joined("lines"), F.lit("\n"), F.coalesce(joined("edge_lines"), F.lit("")), F.lit("\n}\n")).alias("dot"))


def write_dot(dots: DataFrame, path: str, files: int | None = None) -> None:
    """Graph texts as a table of (key, dot), not as a file for each of
    millions of functions. With ``files``, at most so many functions are
    written as text files, in a folder for each."""
    if files is None:
        dots.write.parquet(path)
        return
    if dots.limit(files + 1).count() > files:
        raise ValueError(f"more than {files} functions; write them as a table")
    dots.write.partitionBy(*KEY).option("lineSep", "\n").text(path)
