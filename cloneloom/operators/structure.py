"""From control-flow graphs to trees of control structures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reduction
from ..model import ADDRESS, FUNCTION_KEY, SINK
from .graph import as_arrays

KEY = FUNCTION_KEY

#: Functions whose trees a worker holds at once.
PIECE = 256

#: Graphs of at most so many blocks are reduced once for all functions of a
#: worker that have them, and so many results are remembered.
SMALL, REMEMBERED = 64, 1024

_SPANS = pa.list_(pa.struct([("offset", pa.string()), ("length", pa.string())]))
_NODE = pa.struct(
    [
        ("node_id", pa.int32()), ("parent_id", pa.int32()), ("child_pos", pa.int32()), ("block_type", pa.string()), ("depth", pa.int32()),
        ("offset", pa.string()), ("struct_key", pa.string()), ("strict_key", pa.string()), ("basic_blocks", _SPANS),
    ]
)
_RESULT = (
    "reduced boolean, residual_nodes int, tree array<struct<node_id: int, parent_id: int, child_pos: int, block_type: string, depth: int, "
    "offset: string, struct_key: string, strict_key: string, basic_blocks: array<struct<offset: string, length: string>>>>, clusters string, tree_dot string"
)


def cfg_of(nodes: list[dict], edges: list[dict]) -> reduction.Cfg:
    block = {int(n["offset"]): (int(n["offset"]), int(n["length"])) for n in nodes}
    out: dict[tuple[int, int], list[tuple[int, int]]] = {b: [] for b in block.values()}
    for e in edges:
        out[block[int(e["src"])]].append(block[int(e["dst"])])
    root = next((block[int(n["offset"])] for n in nodes if n["is_root"]), None)
    return reduction.Cfg(root, out)


def bare_cfg(blocks: tuple, edges: tuple, roots: tuple) -> reduction.Cfg:
    """The graph that ``cfg.from_bare`` makes, of one function's (offset,
    length), (src, dst) and roots."""
    block = {b[0]: b for b in sorted(blocks)}
    out: dict[tuple[int, int], list[tuple[int, int]]] = {b: [] for b in block.values()}
    for src, dst in sorted({e for e in edges if e[0] in block and e[1] in block}):
        out[block[src]].append(block[dst])
    at = block.keys() & set(roots or (0,))
    return reduction.Cfg(block[min(at or block)], out)


def _clusters(tree: reduction.Block) -> str:
    """Nested blocks as Graphviz clusters, numbered as they are met."""
    lines: list[str] = []

    def draw(block: reduction.Block, number: int) -> int:
        if not block.children:
            if block.offset != SINK and (block.offset, block.length) != (0, 0):
                lines.append(f"{block.offset};")
            return number
        lines.append(f"subgraph cluster_{number}{{")
        for child in block.children:
            number = draw(child, number + 1)
        lines.append(f'label="{block.label}";\n}}')
        return number

    draw(tree, 0)
    return "\n".join(lines)


def _tree_dot(tree: reduction.Block | None) -> str:
    """The tree in Graphviz; blocks go by their offsets."""
    lines, stack = ["digraph {"], [tree] if tree else []
    while stack:
        block = stack.pop()
        shape = "" if block.children else ';shape="box"'
        lines.append(f'{block.offset}[label="{block.label}"{shape}];')
        lines += [f"{block.offset}->{c.offset}" for c in block.children]
        stack += block.children
    return "\n".join([*lines, "}\n"])


def _reduce(nodes: list[dict], edges: list[dict], drawn: bool) -> list[tuple]:
    tree, left = reduction.reduced(cfg_of(nodes, edges))
    rows = []
    for r in reduction.listed(tree) if tree else []:
        spans = [dict(offset=str(o), length=str(n)) for o, n in r["basic_blocks"]]
        rows.append(r | dict(offset=str(r["offset"]), basic_blocks=spans))
    return [(tree is not None, left, rows, _clusters(tree) if drawn and tree else "", _tree_dot(tree) if drawn else "")]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, PIECE):
            yield batch.slice(start, PIECE)


def reduce_functions(nodes: DataFrame, edges: DataFrame, drawn: bool = False) -> DataFrame:
    """One row a function: (key, reduced, residual_nodes, tree, clusters,
    tree_dot). Graphs of one node are no candidates and should be filtered
    before; ``drawn`` adds Graphviz texts."""
    arrays = as_arrays(nodes, edges)
    types = [pa.bool_(), pa.int32(), pa.list_(_NODE), pa.string(), pa.string()]
    names = ["reduced", "residual_nodes", "tree", "clusters", "tree_dot"]

    def run(batches):
        for batch in _pieces(batches):
            out = [(r[KEY[0]], r[KEY[1]], *_reduce(r["nodes"], r["edges"] or [], drawn)[0]) for r in batch.to_pylist()]
            columns = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.string(), *types], strict=True)], names=[*KEY, *names])

    return arrays.mapInArrow(run, f"binary_id string, function_id string, {_RESULT}")


def _listed(blocks: tuple, edges: tuple, roots: tuple) -> tuple[bool, int, list[dict]]:
    tree, left = reduction.reduced(bare_cfg(blocks, edges, roots))
    return tree is not None, left, reduction.listed(tree) if tree else []


def _outermost(blocks: tuple, edges: tuple, roots: tuple) -> tuple:
    reduced, left, rows = _listed(blocks, edges, roots)
    last = rows[-1] if rows else {}
    return reduced, left, last.get("block_type"), last.get("depth"), last.get("struct_key")


def _all_nodes(blocks: tuple, edges: tuple, roots: tuple) -> list[tuple]:
    names = [f.name for f in _NODE][:-1]
    rows = _listed(blocks, edges, roots)[2]
    return [(*(str(r[n]) if n == "offset" else r[n] for n in names), [(str(o), str(k)) for o, k in r["basic_blocks"]]) for r in rows]


@lru_cache(REMEMBERED)
def _outermost_known(blocks: tuple, edges: tuple, roots: tuple) -> tuple:
    return _outermost(blocks, edges, roots)


@lru_cache(REMEMBERED)
def _all_nodes_known(blocks: tuple, edges: tuple, roots: tuple) -> list[tuple]:
    return _all_nodes(blocks, edges, roots)


def _numbers(column: pa.Array) -> list[int | None]:
    return column.cast(pa.uint64()).to_pylist()


def _graphs(piece: pa.RecordBatch) -> Iterator[tuple[tuple, tuple, tuple]]:
    """(blocks, edges, roots) of each row of ``cfg.gathered``."""
    held = []
    for name, fields in (("blocks", ("offset", "length")), ("edges", ("src", "dst")), ("roots", None)):
        column = piece.column(piece.schema.get_field_index(name))
        flat, at = column.flatten(), column.offsets.to_numpy()
        values = list(zip(*(_numbers(flat.field(f)) for f in fields), strict=True)) if fields else _numbers(flat)
        held.append((values, (at - at[0]).tolist()))
    for i in range(piece.num_rows):
        yield tuple(tuple(values[at[i] : at[i + 1]]) for values, at in held)


def outermost_structures(functions: DataFrame) -> DataFrame:
    """(key, reduced, residual_nodes, block_type, depth, struct_key) of each
    row of ``cfg.gathered``: the last node of its tree, which isn't listed."""
    types = [pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.string()]
    names = ["reduced", "residual_nodes", "block_type", "depth", "struct_key"]

    def run(batches):
        for piece in _pieces(batches):
            out = [(_outermost_known if len(g[0]) <= SMALL else _outermost)(*g) for g in _graphs(piece)]
            found = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(piece.column(piece.schema.get_field_index(k)) for k in KEY), *found], names=[*KEY, *names])

    return functions.mapInArrow(run, "binary_id string, function_id string, reduced boolean, residual_nodes int, block_type string, depth int, struct_key string")


def listed_trees(functions: DataFrame, min_depth: int = 0) -> DataFrame:
    """``tree_nodes`` of the rows of ``cfg.gathered``, a row for each node of at
    least ``min_depth``; no function's tree is held in a row."""
    fields = list(_NODE)
    depth = [f.name for f in fields].index("depth")
    schema = (
        "binary_id string, function_id string, node_id int, parent_id int, child_pos int, block_type string, depth int, "
        "offset string, struct_key string, strict_key string, basic_blocks array<struct<offset: string, length: string>>"
    )

    def run(batches):
        for piece in _pieces(batches):
            rows, place = [], []
            for i, g in enumerate(_graphs(piece)):
                own = [r for r in (_all_nodes_known if len(g[0]) <= SMALL else _all_nodes)(*g) if r[depth] >= min_depth]
                rows += own
                place += [i] * len(own)
            at = pa.array(np.array(place, dtype=np.int64))
            columns = zip(*rows, strict=True) if rows else [()] * len(fields)
            found = [pa.array([[dict(offset=o, length=n) for o, n in x] for x in c] if f.name == "basic_blocks" else c, f.type) for c, f in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*(piece.column(piece.schema.get_field_index(k)).take(at) for k in KEY), *found], names=[*KEY, *(f.name for f in fields)])

    return _as_addresses(functions.mapInArrow(run, schema))


def status(reduced: DataFrame) -> DataFrame:
    """(key, reduced, residual_nodes)."""
    return reduced.select(*KEY, "reduced", "residual_nodes")


def tree_nodes(reduced: DataFrame) -> DataFrame:
    """One row for each node of each tree, as in ``model.TREE_NODES``."""
    return _as_addresses(reduced.filter("reduced").select(*KEY, F.explode("tree").alias("t")).select(*KEY, "t.*"))


def _as_addresses(rows: DataFrame) -> DataFrame:
    spans = F.transform("basic_blocks", lambda b: F.struct(b["offset"].cast(ADDRESS).alias("offset"), b["length"].cast(ADDRESS).alias("length")))
    return rows.withColumn("offset", F.col("offset").cast(ADDRESS)).withColumn("basic_blocks", spans)


def clustered_dot(reduced: DataFrame, cfg_dots: DataFrame) -> DataFrame:
    """(key, dot): the graph's text with its structures as clusters."""
    rows = reduced.select(*KEY, "clusters").join(cfg_dots, KEY)
    body = F.expr("substring(dot, 1, length(dot) - 2)")
    return rows.select(*KEY, F.concat(body, "clusters", F.when(F.length("clusters") > 0, "\n").otherwise(""), F.lit("}\n")).alias("dot"))


def tree_dot(reduced: DataFrame) -> DataFrame:
    """(key, dot) of trees; those that weren't reduced are empty graphs."""
    return reduced.select(*KEY, F.col("tree_dot").alias("dot"))
