"""Control-flow graphs and the trees they reduce to; traversals."""

import re

import pytest

from cloneloom.functions import flow, reduction


def graph(text):
    out = {int(n): [int(c) for c in children.split(",") if c] for n, children in re.findall(r"(\d+):\[([\d,]*)\]", text)}
    return out


def cfg_of(text):
    edges = {(n, 1): [(c, 1) for c in out] for n, out in graph(text).items()}
    return reduction.Cfg((0, 1) if edges else None, edges)


def at(tree, path):
    for k in path:
        tree = tree.children[k]
    return tree


# text, entry first, {path: (label, children, depth)}; () is the root
TREES = {
    "sequence": ("0:[1] 1:[2] 2:[3] 3:[4] 4:[]", 0, {(): ("Sequence", 5, 1)}),
    "self loop": ("0:[1] 1:[2,1] 2:[]", 0, {(): ("Sequence", 3, 2), (1,): ("SelfLooping", 1, 1)}),
    "switch": ("0:[1] 1:[2,3,4,5,6] 2:[7] 3:[7] 4:[7] 5:[7] 6:[7] 7:[]", 0, {(): ("Sequence", 3, None), (1,): ("Switch", 6, None)}),
    "fallthrough 1": ("0:[1,2,3] 1:[2] 2:[4] 3:[4] 4:[]", 0, {(): ("Sequence", 2, None), (0,): ("Switch", None, None)}),
    "fallthrough n": ("0:[1,2,3] 1:[2,3] 2:[4] 3:[4] 4:[]", 0, {(): ("Sequence", 2, None), (0,): ("Switch", None, None)}),
    "switch indirect": ("0:[1,2,3,4] 1:[2] 2:[3,4] 3:[5] 4:[5] 5:[]", 0, {(): ("Sequence", 2, None), (0,): ("Switch", None, None)}),
    "switch exit inside": ("0:[1,2,4,5] 1:[2] 2:[4,3] 3:[4,5] 4:[6] 5:[6] 6:[]", 0, {(): ("Sequence", 2, None), (0,): ("Switch", None, None)}),
    "switch exit outside": (
        "0:[1,7] 1:[2,3,5,6] 2:[3] 3:[5,4] 4:[5,6] 5:[8] 6:[8] 7:[8] 8:[]", 0,
        {(): ("Sequence", 2, None), (0,): ("IfThenElse", None, None), (0, 1): ("Switch", None, None)},
    ),
    "if-then next": ("0:[1] 1:[2,3] 2:[3] 3:[4] 4:[]", 0, {(): ("Sequence", 4, 2), (1,): ("IfThen", 2, 1)}),
    "if-then cond": ("0:[1] 1:[3,2] 2:[3] 3:[4] 4:[]", 0, {(): ("Sequence", 4, 2), (1,): ("IfThen", 2, 1)}),
    "short-circuit": ("0:[1,3] 1:[2,3] 2:[3] 3:[]", 0, {(): ("Sequence", 2, 2), (0,): ("IfThen", 3, 1)}),
    "short-circuit tricky": ("0:[1,4] 1:[2,4] 2:[4,3] 3:[4] 4:[]", 0, {(): ("Sequence", 2, 2), (0,): ("IfThen", 4, None)}),
    "if-else": ("0:[1] 1:[2,3] 2:[4] 3:[4] 4:[5] 5:[]", 0, {(): ("Sequence", 4, 2), (1,): ("IfThenElse", 3, None)}),
    "short-circuit if-else": ("0:[1,3] 1:[2,3] 2:[3,4] 3:[5] 4:[5] 5:[]", 0, {(): ("Sequence", 2, 2), (0,): ("IfThenElse", 5, None)}),
    "if-else looping": (
        "0:[1,2] 1:[3,1] 2:[3,2] 3:[]", 0,
        {(): ("Sequence", 2, 3), (0,): ("IfThenElse", 3, 2), (0, 1): ("SelfLooping", None, None), (0, 2): ("SelfLooping", None, None)},
    ),
    "while without entry": ("0:[1,2] 1:[0] 2:[]", 1, {(1,): ("While", None, None)}),
    "while": ("0:[1] 1:[2,3] 2:[1] 3:[]", 0, {(): ("Sequence", 3, 2), (1,): ("While", None, None)}),
    "do-while without entry": ("0:[1] 1:[0,2] 2:[]", 1, {(1,): ("DoWhile", None, None)}),
    "do-while 1": ("0:[1] 1:[2] 2:[1,3] 3:[]", 0, {(): ("Sequence", 3, 2), (1,): ("DoWhile", None, None)}),
    "do-while 2": ("0:[1] 1:[2] 2:[3] 3:[4,1] 4:[]", 0, {(): ("Sequence", 3, 3), (1,): ("DoWhile", None, None)}),
    "do-while 3": ("0:[1] 1:[2] 2:[3,4] 3:[1] 4:[]", 0, {(): ("Sequence", 3, 2), (1,): ("DoWhile", None, None)}),
    "do-while 4": ("0:[1] 1:[2] 2:[3] 3:[4,5] 4:[1] 5:[]", 0, {(): ("Sequence", 3, 3), (1,): ("DoWhile", None, None)}),
    "structures in loop": ("0:[1] 1:[2] 2:[3,4] 3:[5,3] 4:[5] 5:[6,1] 6:[]", 0, {(): ("Sequence", 3, 5), (1,): ("DoWhile", None, 4)}),
    "nested while": ("0:[1] 1:[4,2] 2:[3,1] 3:[2] 4:[]", 0, {(): ("Sequence", 3, 3), (1,): ("While", None, 2), (1, 1): ("While", None, None)}),
    "nested do-while, shared": ("0:[1] 1:[2] 2:[3,1] 3:[4,2] 4:[]", 0, {(): ("Sequence", 3, 3), (1,): ("DoWhile", None, 2), (1, 0): ("DoWhile", None, None)}),
    "nested do-while": ("0:[1] 1:[2] 2:[3] 3:[4,2] 4:[5,1] 5:[]", 0, {(): ("Sequence", 3, 4), (1,): ("DoWhile", None, None), (1, 0, 1): ("DoWhile", None, None)}),
    "break in while": ("0:[1] 1:[2,4] 2:[3,4] 3:[1] 4:[]", 0, {(): ("Sequence", 3, 3), (1,): ("While", None, None)}),
    "break in do-while": ("0:[1] 1:[2] 2:[3,4] 3:[4,1] 4:[]", 0, {(): ("Sequence", 3, 3), (1,): ("DoWhile", None, None)}),
    "return in while": ("0:[1] 1:[2,6] 2:[3,6] 3:[6,4] 4:[5,8] 5:[8,1] 6:[7] 7:[8] 8:[]", 0, {(): ("Sequence", 5, 3), (1,): ("While", None, None)}),
    "return in do-while": ("0:[1] 1:[2] 2:[3,6] 3:[6,4] 4:[5,8] 5:[8,1] 6:[7] 7:[8] 8:[]", 0, {(): ("Sequence", 5, 3), (1,): ("DoWhile", None, None)}),
    "orphaning": ("0:[1] 1:[2,8] 2:[3,6] 3:[6,4] 4:[5,7] 5:[8,1] 6:[7] 7:[9] 8:[9] 9:[]", 0, {(): ("Sequence", 5, 3), (1,): ("DoWhile", None, None)}),
    "looping sequence": (
        "0:[1,16] 1:[2,16] 2:[3] 3:[4,15] 4:[5] 5:[6,12] 6:[7] 7:[8,11] 8:[9,11] 9:[10] 10:[11,10] 11:[3] 12:[13,14] 13:[7] 14:[7] 15:[5] 16:[3]", 0, {},
    ),
    "proper mini": ("0:[1,2] 1:[2,3] 2:[3] 3:[]", 0, {(): ("Sequence", None, None), (0,): ("ProperInterval", None, None)}),
    "proper left": ("0:[1,2] 1:[3,4] 2:[4] 3:[5] 4:[5] 5:[]", 0, {(): ("Sequence", None, None), (0,): ("ProperInterval", None, None)}),
    "proper right": ("0:[1,2] 1:[3] 2:[3,4] 3:[5] 4:[5] 5:[]", 0, {(): ("Sequence", None, None), (0,): ("ProperInterval", None, None)}),
    "proper cross": ("0:[1,2] 1:[3,4] 2:[3,4] 3:[5] 4:[5] 5:[]", 0, {(): ("Sequence", None, None), (0,): ("ProperInterval", None, None)}),
    "improper": ("0:[1,2] 1:[2,3] 2:[1,3] 3:[]", 0, {(): ("Sequence", None, None), (0,): ("ImproperInterval", None, None)}),
    "sequence extension": ("0:[1,2] 1:[2] 2:[3] 3:[4,6] 4:[5,6] 5:[0] 6:[]", 1, {}),
}

NO_TREES = {
    "empty": "",
    "switch impossible": "0:[1,7] 1:[2,3,5,6] 2:[3] 3:[5,4] 4:[5,6] 5:[7] 6:[8] 7:[8] 8:[]",
    "proper wrong": "0:[1,2] 1:[3,4] 2:[4,5] 3:[6] 4:[6] 5:[6] 6:[]",
}


@pytest.mark.parametrize("name", TREES)
def test_tree(name):
    text, entry, want = TREES[name]
    cfg = cfg_of(text)
    tree, left = reduction.reduced(cfg.with_entry() if entry else cfg)
    assert tree is not None and left == 1
    for path, (label, children, depth) in want.items():
        block = at(tree, path)
        assert block.label == label
        assert children in (None, len(block.children))
        assert depth in (None, block.depth)


@pytest.mark.parametrize("name", NO_TREES)
def test_no_tree(name):
    assert reduction.reduced(cfg_of(NO_TREES[name]))[0] is None


SAMPLE = "0:[1,2] 1:[6] 2:[3,4] 3:[5] 4:[5] 5:[6] 6:[]"


def test_visits():
    g = graph(SAMPLE)
    assert list(flow.breadth_first(g, 0)) == [0, 1, 2, 6, 3, 4, 5]
    assert list(flow.breadth_first(g, 2)) == [2, 3, 4, 5, 6]
    assert flow.preorder(g, 0) == [0, 1, 6, 2, 3, 5, 4]
    assert flow.preorder(g, 2) == [2, 3, 5, 6, 4]
    assert flow.postorder(g, 0) == [6, 1, 5, 3, 4, 2, 0]
    assert flow.postorder(g, 2) == [6, 5, 3, 4, 2]
    assert list(flow.breadth_first({}, None)) == flow.preorder({}, None) == flow.postorder({}, None) == []


def test_parents_components_depths():
    g = graph(SAMPLE)
    parents = flow.predecessors(g, 0)
    assert len(parents) == 7 and parents[5] == {3, 4}
    g = graph("0:[1,2] 1:[6] 2:[3,4] 3:[5] 4:[2] 5:[4,6] 6:[]")
    c = flow.components(g, 0)
    assert c[2] == c[3] == c[4] == c[5] and len({c[0], c[1], c[2], c[6]}) == 4
    assert sorted(set(c.values())) == [0, 1, 2, 3]
    assert flow.depths(graph("0:[1,2] 1:[6] 2:[3] 3:[5] 4:[2] 5:[6,4] 6:[]"), 0) == {0: 4, 1: 1, 2: 3, 3: 2, 4: 0, 5: 1, 6: 0}
    assert flow.looping(c)[2] and not flow.looping(flow.components({0: [0]}, 0))[0]


def test_exits():
    g = graph("0:[1] 1:[2,3] 2:[1,4] 3:[] 4:[]")
    c = flow.components(g, 0)
    assert flow.exits_and_targets(g, c, 1) == ({1, 2}, {3, 4})
    assert flow.without_edges(g, {1, 2}, {4}) == g | {2: [1]}


def test_sink_and_entry():
    cfg = cfg_of("0:[1,2] 1:[] 2:[]")
    assert len(cfg.with_sink().edges) == 4 and cfg.with_entry() is cfg
    cfg = cfg_of("0:[1] 1:[0]")
    assert cfg.with_sink() is cfg and cfg.with_entry().root == (0, 0)


def test_listed_blocks_and_keys():
    B = lambda o: reduction.Block("Basic", o, 10)
    over = reduction.Block.over
    tree = over("Sequence", [B(1), over("IfThenElse", [B(10), B(100), B(1000)])])
    rows = reduction.listed(tree)
    assert [b[0] for b in rows[-1]["basic_blocks"]] == [1, 10, 100, 1000]
    assert rows[-1]["struct_key"] == "Basic|Basic|Basic|Basic|IfThenElse|Sequence"
    assert rows[-1]["strict_key"] == "Sequence(Basic,IfThenElse(Basic,Basic,Basic))"
    assert [r["parent_id"] for r in rows] == [5, 4, 4, 4, 5, None]
    # the labels alone don't tell these apart, the strict key does
    a = reduction.listed(over("IfThen", [B(1), over("IfThen", [B(2), B(3), B(4)])]))[-1]
    b = reduction.listed(over("IfThen", [B(1), B(2), over("IfThen", [B(3), B(4)])]))[-1]
    assert a["struct_key"] == b["struct_key"] and a["strict_key"] != b["strict_key"]
    x = reduction.listed(over("Sequence", [over("SelfLooping", [B(1)]), B(2)]))[-1]
    y = reduction.listed(over("Sequence", [B(1), over("SelfLooping", [B(2)])]))[-1]
    assert x["struct_key"] != y["struct_key"]
