"""Graphs of many functions: one row a function, no joins, small pieces."""

import pyarrow as pa
import pytest

from cloneloom import queries
from cloneloom import views as V
from cloneloom.operators import cfg, structure

RULES = ["do_while", "if_chain", "irreducible", "proper_interval", "switch", "while", "if_else", "improper_interval", "natural_loops"]


@pytest.mark.parametrize("rule", RULES)
def test_rules_move_no_rows(spark, data_dir, rule):
    """Every block and edge of 1.2 million functions was shuffled and joined."""
    plan = queries.QUERIES[f"cfs_{rule}"](spark, data_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_pieces_are_small():
    """A batch of ten thousand functions became Python objects at once."""
    batch = pa.RecordBatch.from_pydict({"x": list(range(2 * structure.PIECE + 1))})
    assert [p.num_rows for p in structure._pieces([batch])] == [structure.PIECE, structure.PIECE, 1]


def test_gathered_functions_are_those_of_joins(spark):
    """Repeated blocks and edges, unknown ones, no root, a null one, one at no
    block, several; a function without blocks is none."""
    key = "binary_id string, function_id string"
    graphs = {
        "plain": ([(16, 4), (32, 4), (48, 4)], [(16, 32), (32, 48)], [16]),
        "repeats": ([(16, 4), (16, 8), (32, 4), (32, 4)], [(16, 32), (16, 32), (32, 16), (16, 99), (99, 16), (None, 16)], [32]),
        "no root": ([(32, 4), (16, 4)], [(16, 32)], []),
        "null root": ([(0, 4), (16, 4)], [(16, 0), (0, 16)], [None]),
        "root elsewhere": ([(16, 4), (2**64 - 32, 4)], [(16, 2**64 - 32)], [7]),
        "two roots": ([(16, 4), (32, 4), (48, 4)], [(32, 16), (16, 48)], [48, 32]),
        "no edges": ([(16, 4)], [], [16]),
        "no blocks": ([], [(16, 32)], [16]),
    }
    of = lambda k: [("b", f, *(x if isinstance(x, tuple) else (x,))) for f, g in graphs.items() for x in g[k]]
    cast = lambda rows, *names: spark.createDataFrame([(*r[:2], *(None if v is None else str(v) for v in r[2:])) for r in rows], f"{key}, " + ", ".join(f"{n} string" for n in names)).selectExpr("binary_id", "function_id", *(f"cast({n} as decimal(20,0)) as {n}" for n in names))
    tables = cast(of(0), "offset", "length"), cast(of(1), "src", "dst"), cast(of(2), "root")
    functions = cfg.gathered(*tables)
    joined = structure.reduce_functions(*cfg.from_bare(*tables))
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    names = [*cfg.KEY, "reduced", "residual_nodes"]
    assert functions.count() == len(graphs) - 1
    assert same(structure.outermost_structures(functions).select(names), joined.select(names))
    assert same(structure.listed_trees(functions), structure.tree_nodes(joined))


def test_shapes_are_those_of_joins(spark, data_dir):
    functions = V.shape_functions(spark, data_dir, V.ALL_SHAPES)
    nodes = structure.tree_nodes(structure.reduce_functions(*cfg.from_bare(*V.shape_graphs(spark, data_dir, V.ALL_SHAPES))))
    listed = structure.listed_trees(functions)
    assert listed.columns == nodes.columns and listed.exceptAll(nodes).isEmpty() and nodes.exceptAll(listed).isEmpty()
    deep = structure.listed_trees(functions, 2)
    assert deep.exceptAll(nodes.filter("depth >= 2")).isEmpty() and deep.count() == nodes.filter("depth >= 2").count()


def test_detection_gathers_in_one_shuffle(spark, data_dir):
    """Nodes and edges were joined four times before they met."""
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    corpus = queries.shape_corpus(spark, data_dir)
    assert "Exchange" not in plan(corpus.gathered()) and "Exchange" not in plan(corpus.several())
    blocks, edges, roots = V.shape_graphs(spark, data_dir, V.ALL_SHAPES)
    tables = type(corpus)(corpus.binaries, corpus.statements, blocks, edges, roots).gathered()
    assert "Join" not in plan(tables)
    names = [*cfg.KEY, "block_type", "depth", "struct_key"]
    a, b = (structure.outermost_structures(rows).select(names) for rows in (corpus.gathered(), tables))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
