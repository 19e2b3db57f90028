"""Whole results of queries without SQL, by plain code."""

from collections import Counter, defaultdict
from html.parser import HTMLParser
from math import sqrt

import pytest

from cloneloom import queries
from cloneloom import views as V
from cloneloom.operators.common import written
from cloneloom.operators.pages import VOID


@pytest.fixture(scope="module")
def transitions(spark, data_dir):
    """Successors in order, and the root, of each graph of events."""
    blocks, edges, roots = V.transition_graphs(spark, data_dir)
    out = {r.function_id: {} for r in blocks.collect()}
    for r in blocks.collect():
        out[r.function_id][int(r.offset)] = []
    for r in edges.distinct().orderBy("dst").collect():
        out[r.function_id][int(r.src)].append(int(r.dst))
    return out, {r.function_id: int(r.root) for r in roots.collect()}


def test_graph_visits(spark, data_dir, transitions):
    """Visits by recursion over marked nodes."""
    graphs, roots = transitions
    rows = defaultdict(dict)
    for r in queries.QUERIES["graph_visits"](spark, data_dir).collect():
        rows[r.function_id][int(r.offset)] = r
    assert rows.keys() == graphs.keys()
    for name, graph in graphs.items():
        root, own = roots[name], rows[name]
        assert own.keys() == graph.keys()
        level, now = {root: 0}, [root]
        while now:
            now = [c for c in dict.fromkeys(c for n in now for c in graph[n]) if c not in level]
            level |= {c: max(level.values()) + 1 for c in now}
        assert {n: r.level for n, r in own.items()} == level
        # breadth first: by level, then by the place of the first parent
        order = sorted(own, key=lambda n: own[n].bfs)
        assert [level[n] for n in order] == sorted(level.values()) and order[0] == root

        marked, pre, post = {root}, [], []

        def visit(node, after):
            """Children are marked all at once, the last first, and visited
            from the first on."""
            if not after:
                pre.append(node)
            fresh = [c for c in reversed(graph[node]) if c not in marked]
            fresh = list(dict.fromkeys(fresh))
            marked.update(fresh)
            for c in reversed(fresh):
                visit(c, after)
            if after:
                post.append(node)

        visit(root, False)
        assert sorted(own, key=lambda n: own[n].pre) == pre
        marked = {root}
        visit(root, True)
        assert sorted(own, key=lambda n: own[n].post) == post
        depth = {}
        for n in post:
            depth[n] = max((depth[c] + 1 for c in graph[n] if c in depth), default=0)
        assert {n: r.depth for n, r in own.items()} == depth


def test_generic_dot(spark, data_dir, transitions):
    graphs, roots = transitions
    rows = {r.function_id: r.dot for r in queries.QUERIES["generic_dot"](spark, data_dir).collect()}
    assert rows.keys() == graphs.keys()
    for name, text in rows.items():
        first, *lines, last = text.split("\n")[:-1]
        assert (first, last) == ("digraph G {", "}")
        assert Counter(lines) == Counter(f'"{a}"->"{b}"' for a, out in graphs[name].items() for b in out)
        if lines:
            assert lines[0].startswith(f'"{roots[name]}"')


def test_trees_of_events(spark, data_dir, transitions):
    """Every reachable block is a leaf; what a node says follows from its
    children. A rule can lead to a block that it replaces, which then is a leaf
    twice."""
    graphs, _ = transitions
    functions = defaultdict(dict)
    for r in queries.QUERIES["cfs_tree_nodes"](spark, data_dir).collect():
        functions[r.function_id][r.node_id] = r
    assert functions
    for name, nodes in functions.items():
        children = defaultdict(list)
        for r in nodes.values():
            children[r.parent_id].append(r)
        (root,) = children[None]
        for r in nodes.values():
            own = sorted(children[r.node_id], key=lambda c: c.child_pos)
            assert [c.child_pos for c in own] == list(range(len(own)))
            assert (r.block_type == "Basic") == (not own)
            if own:
                assert r.depth == 1 + max(c.depth for c in own) and r.offset == min(c.offset for c in own)
                assert r.node_id > max(c.node_id for c in own)
                blocks = [b for c in own for b in (c.basic_blocks or "").split(",") if b]
                assert Counter(b for b in (r.basic_blocks or "").split(",") if b) == Counter(blocks)
        leaves = {int(r.offset) for r in nodes.values() if r.block_type == "Basic"}
        assert graphs[name].keys() <= leaves <= {*graphs[name], 0, 2**64 - 1}
        assert root.node_id == max(nodes)


def test_reductions_of_statements(spark, data_dir):
    rows = queries.QUERIES["cfs_reduce"](spark, data_dir).collect()
    assert any(r.reduced for r in rows)
    for r in rows:
        assert r.reduced == (r.residual_nodes == 1) == (r.struct_key is not None)
        if r.reduced:
            labels = r.struct_key.split("|")
            assert labels[-1] == r.root_type and r.depth <= sum(x != "Basic" for x in labels)


def test_drawn_structures(spark, data_dir):
    trees = {r.function_id for r in queries.QUERIES["cfs_tree_nodes"](spark, data_dir).select("function_id").distinct().collect()}
    plain = {r.function_id: r.dot for r in queries.QUERIES["dot_export"](spark, data_dir).collect()}
    nodes = Counter(r.function_id for r in queries.QUERIES["cfs_tree_nodes"](spark, data_dir).filter("block_type <> 'Basic'").collect())
    for r in queries.QUERIES["cfs_dot"](spark, data_dir).collect():
        assert r.dot.startswith(plain[r.function_id][:-2]) and r.dot.count("{") == r.dot.count("}")
        assert r.dot.count("subgraph cluster_") == nodes[r.function_id]
        assert (r.function_id in trees) == ("label=" in r.tree_dot)


def test_page_classes(spark, data_dir):
    """Trees by a parser that holds nested lists, classes by a dictionary."""

    class Nested(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open = [["document"]]

        def handle_starttag(self, tag, attrs):
            self.open[-1].append(new := [tag])
            if tag not in VOID:
                self.open.append(new)

        def handle_startendtag(self, tag, attrs):
            self.open[-1].append([tag])

        def handle_endtag(self, tag):
            names = [t[0] for t in self.open[1:]]
            if tag in names:
                del self.open[len(names) - names[::-1].index(tag) :]

    def walk(tree):
        """(labels, depth) of all subtrees, the whole one last."""
        out, labels, depth = [], [], 0
        for child in tree[1:]:
            own = walk(child)
            out += own
            labels += own[-1][0]
            depth = max(depth, own[-1][1] + 1)
        return [*out, ((*labels, tree[0]), depth)]

    classes = defaultdict(list)
    for r in spark.read.parquet(f"{data_dir}/pages.parquet").collect():
        parser = Nested()
        parser.feed(r.html or "")
        parser.close()
        for labels, depth in walk(parser.open[0]):
            if depth >= 3:
                classes[labels].append((str(r.page_id), depth))
    want = Counter((len(m), len({p for p, _ in m})) for m in classes.values() if len(m) > 1)
    got = queries.QUERIES["page_classes"](spark, data_dir).collect()
    assert Counter((r["size"], r.pages) for r in got) == want
    depths = {d for m in classes.values() for _, d in m}
    assert all(r.class_depth in depths for r in got)


@pytest.fixture(scope="module")
def parts(spark, data_dir):
    """Trees and counts of the event-made functions, read once."""
    corpus = queries.event_corpus(spark, data_dir)
    from cloneloom.operators import structure

    nodes = written(structure.tree_nodes(structure.reduce_functions(*corpus.graphs())), "nodes").collect()
    blocks = Counter(r.function_id for r in corpus.blocks.collect())
    counts = defaultdict(Counter)
    for r in corpus.statements.collect():
        if blocks[r.function_id] > 1:
            counts[r.function_id][r.instruction.split(" ")[0], r.family] += 1
    return nodes, counts


def near(a, b, least):
    dot = sum(n * b[k] for k, n in a.items())
    return dot / (sqrt(sum(n * n for n in a.values())) * sqrt(sum(n * n for n in b.values()))) > least


def check(rows, classes):
    """Classes as sorted lists of functions with a depth; of those with the
    same functions the deepest counts."""
    deepest = {}
    for members, depth in classes:
        if len(members) > 1:
            key = tuple(sorted(members))
            deepest[key] = max(depth, deepest.get(key, 0))
    got = defaultdict(list)
    for r in rows:
        got[r.clone_class_id, r.class_depth, r["size"]].append(r.function_id)
    assert Counter((tuple(sorted(m)), depth) for (_, depth, _), m in got.items()) == Counter(deepest.items())
    assert all(size == len(m) for (_, _, size), m in got.items())
    sizes = [size for _, _, size in sorted(got)]
    assert sizes == sorted(sizes, reverse=True) and sorted(k for k, _, _ in got) == list(range(len(got)))


def structures(nodes):
    classes = defaultdict(list)
    for r in sorted(nodes, key=lambda r: (r.function_id, r.node_id)):
        if r.depth >= 2:
            classes[r.struct_key].append(r)
    return [m for m in classes.values() if len(m) > 1]


def test_structural_detection(spark, data_dir, parts):
    classes = [([r.function_id for r in m], m[0].depth) for m in structures(parts[0])]
    check(queries.QUERIES["detect_structural"](spark, data_dir).collect(), classes)


def test_semantic_detection(spark, data_dir, parts):
    vectors = {f: Counter() for f in parts[1]}
    for f, own in parts[1].items():
        for (_, family), n in own.items():
            vectors[f][family] += n
    classes = {tuple(sorted(g for g, other in vectors.items() if near(own, other, 0.9))) for own in vectors.values()}
    check(queries.QUERIES["detect_semantic"](spark, data_dir).collect(), [(m, 0) for m in classes])


def test_combined_detection(spark, data_dir, parts):
    nodes, counts = parts
    vectors = {f: Counter() for f in counts}
    for f, own in counts.items():
        for (mnemonic, _), n in own.items():
            vectors[f][mnemonic] += n
    classes = []
    for m in structures(nodes):
        seen = set()
        for seed in m:
            own = tuple((r.function_id, r.node_id) for r in m if near(vectors[seed.function_id], vectors[r.function_id], 0.9))
            if own not in seen:
                seen.add(own)
                depths = [r.depth for r in m if (r.function_id, r.node_id) in own]
                classes.append(([f for f, _ in own], depths[0]))
    check(queries.QUERIES["detect_combined"](spark, data_dir).collect(), classes)
