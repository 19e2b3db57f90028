"""Statements, graphs, vectors, classes and reports against worked examples."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cloneloom.functions import blocks as B
from cloneloom.functions import statements as S
from cloneloom.model import BLOCKS, EDGES, FAMILIES, FUNCTION_KEY, STATEMENTS, family_spellings
from cloneloom.operators import cfg, combined, graph, results, semantic, structural, structure, vectors
from cloneloom.plans.detect import Corpus, cross_architecture, detect_clones
from cloneloom.sources import disassembler, dot, dumps

KEY = FUNCTION_KEY
SINK = Decimal(2**64 - 1)


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def statements(spark, listing, function="f", binary="b"):
    rows = [(binary, function, k, Decimal(at), "unk", text) for k, (at, text) in enumerate(listing)]
    return spark.createDataFrame(rows, STATEMENTS).withColumn("instruction", S.instruction(F.col("instruction")))


def graph_of(spark, listing, end, **more):
    st = statements(spark, listing)
    ends = spark.createDataFrame([("b", "f", Decimal(end))], "binary_id string, function_id string, fn_end decimal(20,0)")
    return cfg.from_statements(st, ends, F.lit("x86"), **more)


def offsets(nodes):
    return sorted(int(r.offset) for r in nodes.collect())


def out_of(edges):
    found = {}
    for r in edges.orderBy("src", "pos").collect():
        found.setdefault(int(r.src), []).append(int(r.dst))
    return found


def root_of(nodes):
    return [int(r.offset) for r in nodes.filter("is_root").collect()]


# -- statements


@pytest.mark.parametrize(
    "raw, instruction, mnemonic, args",
    [
        ("ret ", "ret", "ret", ""),
        ("mov r9d, dword [rsp + r10 + 0x20]", "mov r9d, dword [rsp + r10 + 0x20]", "mov", "r9d, dword [rsp + r10 + 0x20]"),
        ("CMP RAX, r8", "cmp rax, r8", "cmp", "rax, r8"),
        ("", "", "", ""),
    ],
)
def test_statements(spark, raw, instruction, mnemonic, args):
    row = S.parse(spark.createDataFrame([(raw,)], "instruction string")).first()
    assert (row.instruction, row.mnemonic, row.args) == (instruction, mnemonic, args)


def test_jumps(spark):
    want = {"jmp": "JumpUnconditional", "ret": "RetUnconditional", "jo": "JumpConditional", "jnl": "JumpConditional", "jcxz": "JumpConditional", "mul": "NoJump", "": "NoJump"}
    rows = spark.createDataFrame([(k,) for k in want], "m string").withColumn("j", S.jump(F.lit("x86"), F.col("m")))
    assert {r.m: r.j for r in rows.collect()} == want
    want = {"b": "JumpUnconditional", "bl": "NoJump", "bxle": "RetConditional", "bx": "RetUnconditional", "ret": "NoJump", "mov": "NoJump"}
    want |= {f"b{c}": "JumpConditional" for c in S.ARM_CONDITIONS} | {f"b.{c}": "JumpConditional" for c in S.ARM_CONDITIONS}
    rows = spark.createDataFrame([(k,) for k in want], "m string").withColumn("j", S.jump(F.lit("arm"), F.col("m")))
    assert {r.m: r.j for r in rows.collect()} == want
    assert one(spark, S.jump(F.lit("mips"), F.lit("j"))) is None


@pytest.mark.parametrize("text, value", [("0x10", 16), ("12", 12), ("0xffffffffffffffff", 2**64 - 1), ("0b101", 5), ("0o17", 15), ("rax", None), ("[rip + 4]", None), ("99999999999999999999", None), ("", None)])
def test_numbers(spark, text, value):
    found = one(spark, S.number(F.lit(text)))
    assert found == (None if value is None else Decimal(value))


def test_families(spark):
    assert len(FAMILIES) == 48 and len(family_spellings()) == 68
    rows = spark.createDataFrame([(k,) for k in [*family_spellings(), "bogus", None]], "t string")
    got = {r.t: r.family for r in S.with_family(rows, "t").collect()}
    assert got == family_spellings() | {"bogus": "unk", None: "unk"}


def test_bits(spark):
    rows = spark.createDataFrame([("x86", 64), ("avr", 64), ("tricore", 32)], "arch string, bits int")
    assert {r.arch: r.bits for r in S.with_bits(rows).collect()} == {"x86": 64, "avr": 8}


# -- graphs from statements

COND = [(0x610, "test"), (0x612, "je 0x620"), (0x614, "test"), (0x616, "mov"), (0x61B, "je 0x620"), (0x61D, "ret"), (0x620, "mov"), (0x625, "ret")]


def test_conditional_jumps(spark):
    nodes, edges = graph_of(spark, COND, 0x626)
    assert offsets(nodes) == [0x610, 0x614, 0x61D, 0x620]
    assert out_of(edges) == {0x610: [0x614, 0x620], 0x614: [0x61D, 0x620]}
    assert root_of(nodes) == [0x610]


def test_unconditional_jumps(spark):
    listing = [(0x61E, "push"), (0x61F, "mov"), (0x622, "mov"), (0x625, "cmp"), (0x62A, "jne 0x633"), (0x62E, "mov"), (0x631, "jmp 0x638"), (0x633, "mov"), (0x638, "pop"), (0x639, "ret")]
    nodes, edges = graph_of(spark, listing, 0x640)
    assert offsets(nodes) == [0x61E, 0x62E, 0x633, 0x638]
    assert int(cfg.successor(edges, 0).filter(F.col("src") == 0x61E).first().dst) == 0x62E
    assert int(cfg.successor(edges, 1).filter(F.col("src") == 0x61E).first().dst) == 0x633
    assert cfg.successor(edges, 1).filter(F.col("src") == 0x62E).count() == 0


def test_jumps_out_of_the_function(spark):
    listing = [(0x610, "test"), (0x611, "je 0x613"), (0x612, "jmp 0xFFFFFFFFFFFFFFFC"), (0x613, "jmp 0x600"), (0x614, "jmp 0x615"), (0x615, "ret")]
    nodes, edges = graph_of(spark, listing, 0x616)
    assert len(offsets(nodes)) == 5
    assert 0x612 not in out_of(edges) and 0x613 not in out_of(edges)
    listing = [(0x10, "je 0x40"), (0x14, "ret")]
    assert offsets(graph_of(spark, listing, 0x18)[0]) == [0x10, 0x14]
    assert offsets(graph_of(spark, listing, 0x18, outside_targets=True)[0]) == [0x10, 0x14, 0x40]


def test_block_lengths(spark):
    listing = [(0x610, "test"), (0x614, "je 0x628"), (0x618, "test"), (0x61C, "mov"), (0x620, "je 0x628"), (0x624, "ret"), (0x628, "mov"), (0x62C, "ret")]
    nodes, _ = graph_of(spark, listing, 0x630)
    assert sorted((int(r.offset), int(r.length)) for r in nodes.collect()) == [(0x610, 8), (0x618, 12), (0x624, 4), (0x628, 8)]


def test_wide_offsets(spark):
    base = 0x3FD1A7EF534
    listing = [(base, "je %d" % (base + 12)), (base + 4, "mov"), (base + 8, "je %d" % (base + 20)), (base + 12, "mov"), (base + 16, "jmp %d" % (base + 24)), (base + 20, "ret"), (base + 24, "ret")]
    assert len(offsets(graph_of(spark, listing, base + 28)[0])) == 5


def test_sink_and_entry(spark):
    nodes, edges = graph_of(spark, [(0x61C, "mov"), (0x620, "je 0x628"), (0x624, "ret"), (0x628, "mov"), (0x62C, "ret")], 0x630)
    more, ways = cfg.add_sink(nodes, edges)
    assert nodes.count() == 3 and more.count() == 4
    assert sorted(s for s, d in out_of(ways).items() if int(SINK) in d) == [0x624, 0x628]
    alone = graph_of(spark, [(0x61C, "mov"), (0x620, "ret")], 0x624)
    assert cfg.add_sink(*alone)[0].count() == 1 and cfg.add_entry_point(*alone)[0].count() == 1
    nodes, edges = graph_of(spark, [(0x61C, "mov"), (0x620, "jne 0x61c"), (0x624, "ret")], 0x628)
    more, ways = cfg.add_entry_point(nodes, edges)
    assert nodes.count() == 2 and more.count() == 3 and root_of(more) == [0] and out_of(ways)[0] == [0x61C]


def test_root_when_all_blocks_are_led_to(spark):
    nodes, _ = graph_of(spark, [(0x61C, "jmp 0x620"), (0x620, "jmp 0x61c")], 0x624)
    assert root_of(nodes) == [0x61C]


BARE = dict(
    blocks=[(0x1000, 20), (0x1014, 2), (0x1016, 5)],
    edges=[(0x1000, 0x1016), (0x1000, 0x1014), (0x1014, 0x1016), (0x1000, 0x1016), (0x1016, 0x9999)],
    root=0x1000,
)


def bare(spark, blocks, edges, root):
    b = spark.createDataFrame([("b", "f", Decimal(o), Decimal(n)) for o, n in blocks], BLOCKS)
    e = spark.createDataFrame([("b", "f", Decimal(s), Decimal(d)) for s, d in edges], EDGES)
    r = spark.createDataFrame([("b", "f", None if root is None else Decimal(root))], "binary_id string, function_id string, root decimal(20,0)")
    return b, e, r


def test_bare_graphs(spark):
    nodes, edges = cfg.from_bare(*bare(spark, **BARE))
    assert out_of(edges) == {0x1000: [0x1014, 0x1016], 0x1014: [0x1016]}
    assert offsets(nodes) == [0x1000, 0x1014, 0x1016] and root_of(nodes) == [0x1000]
    assert root_of(cfg.from_bare(*bare(spark, **BARE | {"root": 0x1014}))[0]) == [0x1014]
    assert root_of(cfg.from_bare(*bare(spark, **BARE | {"root": None}))[0]) == [0x1000]


@pytest.mark.parametrize("grow", ["plain", "sink", "entry"])
def test_dot_round_trip(spark, grow):
    listing = COND if grow != "entry" else [(0x61C, "mov"), (0x620, "jne 0x61c"), (0x624, "ret")]
    nodes, edges = graph_of(spark, listing, 0x630)
    if grow == "sink":
        nodes, edges = cfg.add_sink(nodes, edges)
    if grow == "entry":
        nodes, edges = cfg.add_entry_point(nodes, edges)
    got_nodes, got_edges, problems = dot.parse(cfg.to_dot(nodes, edges))
    assert problems.count() == 0
    assert sorted(got_nodes.collect()) == sorted(nodes.select(*got_nodes.columns).collect())
    assert out_of(got_edges) == out_of(edges)


def test_dot_problems_and_files(spark, tmp_path):
    rows = [("b", "x", "graph{\n}"), ("b", "y", 'digraph{\n1[comment="(1,1)"];\n1->2[color="red"];\n}')]
    nodes, edges, problems = dot.parse(spark.createDataFrame(rows, "binary_id string, function_id string, dot string"))
    assert {r.function_id: r.problem for r in problems.collect()} == {"x": "unexpected input filetype", "y": "inconsistent data"}
    assert nodes.count() == 0 and edges.count() == 0
    made = graph_of(spark, COND, 0x626)
    cfg.write_dot(cfg.to_dot(*made), str(tmp_path / "dots"), files=10)
    read = dot.read_files(spark, str(tmp_path / "dots/*/*"))
    assert out_of(dot.parse(read)[1]) == out_of(made[1])


def test_graph_tables(spark):
    blocks = [(k, 1) for k in range(7)]
    edges = [(0, 1), (0, 2), (1, 6), (2, 3), (2, 4), (3, 5), (4, 2), (5, 4), (5, 6)]
    nodes, ways = cfg.from_bare(*bare(spark, blocks, edges, 0))
    seen = {int(r.offset): r for r in graph.visits(nodes, ways).collect()}
    assert seen[2].scc == seen[3].scc == seen[4].scc == seen[5].scc and len({seen[k].scc for k in (0, 1, 2, 6)}) == 4
    assert [k for k, r in sorted(seen.items()) if r.is_loop] == [2, 3, 4, 5]
    assert {int(r.offset): r.level for r in graph.levels(nodes, ways).collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 2}
    preds = graph.predecessors(nodes, ways, graph.levels(nodes, ways)).collect()
    assert sorted((int(r.offset), None if r.pred is None else int(r.pred)) for r in preds if r.offset in (0, 6)) == [(0, None), (6, 1), (6, 5)]
    exits = graph.loop_exits(ways, graph.visits(nodes, ways).select(*KEY, "offset", "scc")).filter(F.col("exit") == 5).collect()
    assert [(int(r.exit), int(r.target)) for r in exits] == [(5, 6)]
    gone = ways.filter((F.col("src") == 2) & (F.col("dst") == 3)).select(*KEY, "src", "dst")
    left = graph.remove_edges(ways, gone).filter(F.col("src") == 2).collect()
    assert [(int(r.dst), r.pos) for r in left] == [(4, 0)]
    text = graph.to_dot(nodes, ways, directed=False).first().dot
    assert text.startswith('graph G{\n"0"--"1"\n"0"--"2"\n') and text.count("--") == 9


# -- clones

BASE = [
    "test eax, eax", "jg 0x38", "add ebx, 5", "jmp 0x10", "cmp eax, ebx", "jne 0x20", "cmp ebx, 5", "jne 0x18", "mov ecx, [ebp+8]", "jmp 0x28",
    "cmp ecx, eax", "mov eax, -1", "jne 0x08", "ret", "incl eax", "mov ebx, [ebp+20]", "cmp eax, ebx", "je 0x58", "mov ecx, [ebp+20]", "decl ecx",
    "mov [ebp+20], ecx", "jmp 0x38", "test eax, eax", "mov eax, 0", "je 0x68", "mov eax, 1", "ret",
]


def functions(spark, listings):
    """(statements, nodes, edges) of {function: instructions}, 4 bytes each."""
    rows = [("b", f, 4 * 0 + k, Decimal(4 * k), "unk", text) for f, own in listings.items() for k, text in enumerate(own)]
    st = spark.createDataFrame(rows, STATEMENTS)
    ends = spark.createDataFrame([("b", f, Decimal(4 * len(own))) for f, own in listings.items()], "binary_id string, function_id string, fn_end decimal(20,0)")
    return st, *cfg.from_statements(st, ends, F.lit("x86"))


def replaced(places):
    return ["nop" if k in places else text for k, text in enumerate(BASE)]


def classes(members):
    found = {}
    for r in members.collect():
        found.setdefault(r.class_key, []).append(r)
    return list(found.values())


@pytest.fixture(scope="module")
def five(spark):
    return functions(spark, {f"f{k}": BASE for k in range(5)})


def test_structural_full(spark, five):
    tree = structure.tree_nodes(structure.reduce_functions(*cfg.add_sink(*five[1:])))
    found = classes(structural.structural_members(tree, 7))
    assert [len(c) for c in found] == [5]


def test_structural_partial(spark):
    _, nodes, edges = functions(spark, {"a": BASE, "b": replaced({2, 3, 10, 11, 12})})
    tree = structure.tree_nodes(structure.reduce_functions(*cfg.add_sink(nodes, edges)))
    found = classes(structural.structural_members(tree, 2))
    assert [c[0].class_depth for c in found] == [2, 2]


def vecs_of(st):
    return vectors.vectors(vectors.opcode_counts(st, vectors.opcode_column(False)).drop("total", "frequency"))


def test_semantic_full_and_different(spark, five):
    assert [len(c) for c in classes(semantic.semantic_members(vecs_of(five[0]), 0.7))] == [5]
    st, *_ = functions(spark, {"a": BASE, "b": replaced(range(15))})
    assert classes(semantic.semantic_members(vecs_of(st), 0.7)) == []


def test_semantic_classes_are_neighbourhoods(spark):
    """a is near b, b near c, but a not near c: three overlapping classes."""
    rows = [("x", f, op) for f, n in {"a": (10, 0), "b": (10, 5), "c": (10, 12)}.items() for op, k in zip("pq", n, strict=True) for _ in range(k)]
    counts = vectors.opcode_counts(spark.createDataFrame(rows, "binary_id string, function_id string, opcode string"), F.col("opcode"))
    found = sorted(sorted(r.function_id for r in c) for c in classes(semantic.semantic_members(vectors.vectors(counts), 0.85)))
    assert found == [["a", "b"], ["a", "b", "c"], ["b", "c"]]


def test_thresholds(spark, five):
    """The similarity must be over its threshold, the depth at it or over."""
    assert classes(semantic.semantic_members(vecs_of(five[0]), 1.0)) == []
    tree = structure.tree_nodes(structure.reduce_functions(*cfg.add_sink(*five[1:])))
    top = tree.agg(F.max("depth")).first()[0]
    assert structural.structural_members(tree, top).count() == 5 and structural.structural_members(tree, top + 1).count() == 0


def corpus(spark, listings):
    st, nodes, edges = functions(spark, listings)
    binaries = spark.createDataFrame([("b", "/bin/b", "x86", 64)], "binary_id string, path string, arch string, bits int")
    return Corpus(binaries, st, nodes.select(*KEY, "offset", "length"), edges.select(*KEY, "src", "dst"), nodes.filter("is_root").select(*KEY, F.col("offset").alias("root")))


def test_detection_modes(spark, tmp_path):
    own = corpus(spark, {"a": BASE, "b": BASE, "c": replaced({0, 8, 11, 15, 18, 19, 20, 22, 23, 25})})
    structural_only = detect_clones(own, "structural", min_depth=3, sort="depth-desc")
    both = detect_clones(own, "combined", min_depth=3, sort="depth-desc")
    assert structural_only.select("function_id").distinct().count() == 3
    assert {r.function_id for r in both.collect()} == {"a", "b"}
    meaning = detect_clones(own, "semantic", arch_mode="same")
    assert {(r.clone_class_id, r.class_depth, r.binary_id, r.function_id) for r in meaning.collect()} == {(0, 0, "[x86_64]/bin/b", f) for f in "ab"}
    unfiltered = detect_clones(own, "structural", min_depth=3, dedup=False)
    keys = lambda rows: {(r.binary_id, r.function_id, r.node_id) for r in rows.collect()}
    assert keys(structural_only) <= keys(unfiltered) and keys(both) <= keys(unfiltered)
    lines = list(results.text_lines(both, basic_blocks=True))
    assert lines[0].startswith("----- CLONE CLASS (") and lines[1].startswith("[x86_64]/bin/b :: a [0x0")
    assert lines[-1] == f"Classes: {both.agg(F.countDistinct('clone_class_id')).first()[0]} Clones: {both.count()}"
    assert list(results.text_lines(meaning, basic_blocks=True))[1:] == ["----------------------------", "Classes: 1 Clones: 2"]
    results.write_csv(both, str(tmp_path / "out"), basic_blocks=True)
    read = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert read.columns == ["arch", "bits", "binary", "function", "clone_class_id", "class_depth", "basic_blocks"]
    assert read.count() == both.count() and {r.binary for r in read.collect()} == {"/bin/b"}


def test_deepest_class_stays(spark):
    rows = [("k1", 3, "b", "f"), ("k1", 3, "b", "g"), ("k2", 5, "b", "g"), ("k2", 5, "b", "f"), ("k3", 9, "b", "f"), ("k3", 9, "b", "f")]
    members = spark.createDataFrame(rows, "class_key string, class_depth int, binary_id string, function_id string")
    assert {r.class_key for r in results.deepest_only(members).collect()} == {"k2", "k3"}
    ranked = results.ranked(members, "depth-desc")
    assert {r.class_key: r.clone_class_id for r in ranked.collect()} == {"k3": 0, "k2": 1, "k1": 2}
    with pytest.raises(ValueError):
        results.ranked(members, "sideways")


def test_choice_of_opcodes(spark):
    make = lambda *a: spark.createDataFrame([(str(k), str(k), arch, 64) for k, arch in enumerate(a)], "binary_id string, path string, arch string, bits int")
    same, different = make("x86", "x86"), make("x86", "arm")
    assert not cross_architecture(same) and cross_architecture(different)
    assert cross_architecture(same, compat_autodetect=True) and not cross_architecture(different, compat_autodetect=True)
    assert cross_architecture(same, mode="semantic") and cross_architecture(same, "cross") and not cross_architecture(different, "same", "semantic")


def test_missing_vectors_drop_out(spark, five):
    tree = structure.tree_nodes(structure.reduce_functions(*cfg.add_sink(*five[1:])))
    some = vecs_of(five[0].filter("function_id <> 'f0'"))
    assert {r.function_id for r in combined.combined_members(structural.structural_members(tree, 7), some).collect()} == {"f1", "f2", "f3", "f4"}


def test_block_functions(spark):
    blocks = F.array(B.new_sink(), B.block(F.lit(255), F.lit(1)), B.new_entry_point(), B.block(B.address(2**63 + 1), F.lit(1)))
    assert one(spark, B.block_list(blocks)) == "0x0,0xff,0x8000000000000001"
    assert one(spark, B.kind(B.address(2**64 - 1), F.lit(0))) == "sink" and one(spark, B.kind(F.lit(0), F.lit(0))) == "entry"
    assert one(spark, B.title(F.lit("While"), F.lit(8))) == "While_8" and one(spark, B.title(F.lit("Basic"), F.lit(8))) == "8"


def test_structure_texts(spark, five):
    reduced = structure.reduce_functions(*five[1:], drawn=True)
    row = structure.clustered_dot(reduced, cfg.to_dot(*five[1:])).first()
    assert row.dot.startswith("digraph{") and row.dot.endswith("}\n") and "subgraph cluster_0{" in row.dot
    assert row.dot.count("{") == row.dot.count("}")
    assert '[label="Sequence"];' in structure.tree_dot(reduced).first().dot
    assert structure.status(reduced).filter("reduced and residual_nodes = 1").count() == 5


# -- dumps


def test_dump_parsers(spark):
    dump = lambda out: spark.createDataFrame([("b", "f", out)], "binary_id string, function_id string, output string")
    names = dumps.function_names(dump('[{"offset":1,"name":"a"},{"offset":18446744073709551615,"name":"z"},{"name":"no"},{"offset":2,"name":"a"}]'))
    assert {r.name: int(r.offset) for r in names.collect()} == {"a": 2, "z": 2**64 - 1}
    assert sorted(int(r.offset) for r in dumps.function_offsets(dump("[3,1,3]")).collect()) == [1, 3]
    body = dumps.function_bodies(dump('{"ops":[{"offset":1,"type":"rcjmp","opcode":"JE 0x4 "},{"offset":2,"type":"weird","opcode":"x"},{"offset":3,"type":"add"}]}'))
    assert [(int(r.offset), r.family, r.instruction) for r in body.orderBy("pos").collect()] == [(1, "cjmp", "je 0x4"), (2, "unk", "x")]
    assert dumps.architectures(dump('{"bin":{"arch":"arm","bits":32}}')).first().bits == 32
    assert dumps.architectures(dump("{}")).count() == 0
    edges = dumps.text_edges(dump('digraph {\n "0x10" -> "0X2f" [color=red];\n"0x11111111111111111" -> "0x1"\nnothing'))
    assert [(int(r.src), int(r.dst)) for r in edges.collect()] == [(0x10, 0x2F)]
    blocks = dumps.text_blocks(dump("0x00000610 0x00000612 00:0000 20 j 0x1 f 0x2\n0x10 a b c"))
    assert [(int(r.offset), int(r.length)) for r in blocks.collect()] == [(0x610, 20)]


def test_missing_disassembler(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        disassembler.extract_one(str(tmp_path / "none"))
    here = tmp_path / "file"
    here.write_text("no program")
    with pytest.raises(BrokenPipeError):
        disassembler.extract_one(str(here), tool="no-such-tool")
    rows = disassembler.extract(spark, spark.createDataFrame([(str(here),)], "path string"), tool="no-such-tool").collect()
    assert rows[0].command == "error" and "BrokenPipeError" in rows[0].output


def test_command_line(spark, tmp_path, capsys):
    from cloneloom.__main__ import main

    own = corpus(spark, {"a": BASE, "b": BASE})
    for name in ("binaries", "statements", "blocks", "edges", "roots"):
        getattr(own, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert main([str(tmp_path), "-m", "3", "-s", "depth-desc"], spark) == 0
    said = capsys.readouterr().out
    assert "----- CLONE CLASS (" in said and "[x86_64]/bin/b :: a" in said and "Clones: " in said
    assert main([str(tmp_path), "--disable-structural", "-c", str(tmp_path / "csv")], spark) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    main([str(tmp_path), "--disable-structural", "--disable-semantic"], spark)
    assert "Classes: 0 Clones: 0" in capsys.readouterr().out


def test_streaming_arrivals(spark, five, tmp_path):
    from cloneloom.streaming import arrivals

    tree = structure.tree_nodes(structure.reduce_functions(*cfg.add_sink(*five[1:])))
    known = arrivals.known_keys(tree, 3)
    arrays = graph.as_arrays(*cfg.add_sink(*five[1:])).filter("function_id = 'f0'")
    arrays.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(arrays.schema).parquet(str(tmp_path / "in"))
    query = arrivals.watch(stream, known, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.count() > 0 and {r.function_id for r in found.collect()} == {"f0"} and found.agg(F.min("known")).first()[0] >= 5


STUB = '''#!{python}
import json, sys, time
n = int(open(sys.argv[-1]).read())
for line in sys.stdin:
    for command in line.strip().split("; "):
        if command.startswith("?e "):
            print(command[3:])
        elif command == "ij":
            print(json.dumps({{"bin": {{"arch": "x86", "bits": 64}}}}))
        elif command == "aaa":
            open(sys.argv[-1] + ".analysed", "a").write("x")
            time.sleep(30 if n == 7 else 0)
        elif command == "aflj":
            print(json.dumps([{{"offset": 16 * k, "name": "f%d" % k}} for k in range(n)]))
        elif " @ " in command:
            what, at = command.split(" @ ")
            print(json.dumps({{"ops": [{{"offset": int(at), "type": "mov", "opcode": "mov eax, 1"}}]}}) if what == "pdfj" else what + at)
        sys.stdout.flush()
'''


def test_extraction_of_many_functions(spark, tmp_path):
    """More commands than an argument could hold, after one analysis; a
    binary whose analysis takes too long gives an error alone."""
    import sys

    tool = tmp_path / "stub"
    tool.write_text(STUB.format(python=sys.executable))
    tool.chmod(0o755)
    for name, n in (("many", 5000), ("none", 0), ("slow", 7)):
        (tmp_path / name).write_text(str(n))
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("many", "none", "slow")], "path string")
    table = disassembler.extract(spark, paths, tool=str(tool), timeout=5.0).cache()
    found = {(r.binary_id.rsplit("/", 1)[1], r.command): r["count"] for r in table.groupBy("binary_id", "command").count().collect()}
    assert found == {("many", "ij"): 1, ("many", "aflj"): 1, ("many", "pdfj"): 5000, ("many", "afb"): 5000, ("many", "agfdm"): 5000, ("none", "ij"): 1, ("none", "aflj"): 1, ("slow", "error"): 1}
    assert (tmp_path / "many.analysed").read_text() == "x"
    bodies = dumps.function_bodies(table.filter("command = 'pdfj'"))
    assert bodies.count() == 5000 and bodies.filter("function_id = 'f12' and offset = 192").count() == 1


def test_dots_of_many_functions_are_a_table(spark, tmp_path):
    dots = spark.createDataFrame([("b", f"f{k}", "digraph{}") for k in range(20)], "binary_id string, function_id string, dot string")
    cfg.write_dot(dots, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 20
    with pytest.raises(ValueError):
        cfg.write_dot(dots, str(tmp_path / "files"), files=10)


def test_csv_lines_and_phases(spark):
    members = spark.createDataFrame([("[x86_64]/bin/a, b", "f", 0, 2), ("[x86_64]/bin/c", "g", 0, 2)], "binary_id string, function_id string, clone_class_id long, class_depth int")
    assert list(results.csv_lines(members)) == ["arch,bits,binary,function,clone_class_id,class_depth", 'x86,64,"/bin/a, b",f,0,2', "x86,64,/bin/c,g,0,2"]


def test_shared_folder_is_needed_on_a_cluster(spark, monkeypatch):
    from cloneloom.operators import common

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return spark.sparkContext.getConf()

    class Session:
        conf, sparkContext = spark.conf, Context()

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(RuntimeError):
            common.shared_dir(Session())
