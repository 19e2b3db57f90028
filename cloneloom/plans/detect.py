"""Clone detection as one call: what the command line does."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.statements import tag
from ..model import FUNCTION_KEY
from ..operators import cfg, combined, results, semantic, structural, structure, vectors
from ..operators.common import written

MODES = ("combined", "structural", "semantic")
ARCH_MODES = ("auto", "same", "cross")


@dataclass
class Corpus:
    """What is analysed. ``binaries``: (binary_id, path, arch, bits);
    ``statements`` and bare graphs as in ``model``; ``roots``: (key, root).
    ``functions`` (key, blocks, edges, roots), as ``cfg.gathered`` gives them,
    can stand for blocks, edges and roots. ``statements`` or graphs can be left
    out for modes that don't use them."""

    binaries: DataFrame
    statements: DataFrame | None = None
    blocks: DataFrame | None = None
    edges: DataFrame | None = None
    roots: DataFrame | None = None
    functions: DataFrame | None = None

    def graphs(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) of functions with more than one block."""
        nodes, edges = cfg.from_bare(self.blocks, self.edges, self.roots)
        nodes, edges = written(nodes, "cfg_nodes"), written(edges, "cfg_edges")
        several = nodes.groupBy(*FUNCTION_KEY).count().filter("count > 1").select(*FUNCTION_KEY)
        return nodes.join(several, FUNCTION_KEY, "left_semi"), edges.join(several, FUNCTION_KEY, "left_semi")

    def several(self) -> DataFrame | None:
        """Keys of functions with more than one block."""
        if self.functions is not None:
            return self.functions.filter(F.size("blocks") > 1).select(*FUNCTION_KEY)
        if self.blocks is not None:
            return self.blocks.groupBy(*FUNCTION_KEY).count().filter("count > 1").select(*FUNCTION_KEY)

    def gathered(self) -> DataFrame:
        """Functions with more than one block, a row each."""
        rows = cfg.gathered(self.blocks, self.edges, self.roots) if self.functions is None else self.functions
        return rows.filter(F.size("blocks") > 1)


def cross_architecture(binaries: DataFrame, arch_mode: str = "auto", mode: str = "combined", compat_autodetect: bool = False) -> bool:
    """Whether opcodes are families.

    An explicit mode wins; without the structural step families are used; else
    they are used if the binaries' architectures differ. ``compat_autodetect``
    inverts that last choice.
    """
    if arch_mode not in ARCH_MODES:
        raise ValueError(f"arch_mode must be one of {', '.join(ARCH_MODES)}")
    if arch_mode != "auto":
        return arch_mode == "cross"
    if mode == "semantic":
        return True
    return bool(results.architectures_differ(binaries).first()["differ"]) != compat_autodetect


def tags(binaries: DataFrame, name: str = "_tag") -> DataFrame:
    """(binary_id, name): ``[arch_bits]path`` of each binary."""
    return binaries.select("binary_id", tag(F.col("arch"), F.col("bits"), F.col("path")).alias(name))


def tagged(members: DataFrame, binaries: DataFrame) -> DataFrame:
    """Members whose binary_id is ``[arch_bits]path``."""
    return members.join(tags(binaries), "binary_id").withColumn("binary_id", F.col("_tag")).drop("_tag")


def named_apart(vecs: DataFrame, binaries: DataFrame) -> bool:
    """Whether each binary of the vectors has one tagged name, its own. If so,
    classes of different vectors never have the same tagged functions."""
    names = tags(binaries)
    n, ids, different = names.agg(F.count(F.lit(1)), F.countDistinct("binary_id"), F.countDistinct("_tag")).first()
    return n == ids == different and vecs.join(names, "binary_id", "left_anti").isEmpty()


def detect_clones(
    corpus: Corpus,
    mode: str = "combined",
    min_depth: int = 3,
    min_similarity: float = 0.99,
    arch_mode: str = "auto",
    sort: str = "none",
    dedup: bool = True,
    strict: bool = False,
    compat_autodetect: bool = False,
    report: Callable[[str], None] | None = None,
) -> DataFrame:
    """Members of clone classes, numbered: (clone_class_id, class_depth, size,
    binary_id, function_id, and for structural classes node_id, depth,
    basic_blocks). ``binary_id`` is a tagged name.

    ``report`` gets a line at the end of each phase, with what it found; it
    makes vectors and members be written, to count them.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")

    def phase(rows: DataFrame, name: str, what: str) -> DataFrame:
        if report is None:
            return rows
        rows = written(rows, name)
        report(f"{what}: {rows.count()}")
        return rows

    vecs = None
    if mode != "structural":
        cross = cross_architecture(corpus.binaries, arch_mode, mode, compat_autodetect)
        statements = corpus.statements
        several = corpus.several()
        if several is not None:
            # as many rows as functions, more than their estimate tells: never broadcast
            statements = statements.join(several.hint("merge"), FUNCTION_KEY, "left_semi")
        vecs = vectors.vectors(vectors.opcode_counts(statements, vectors.opcode_column(cross)).drop("total", "frequency"))
        vecs = phase(vecs, "function_vectors", "functions with a vector")
    if mode == "semantic":
        vecs = written(vecs, "vectors")
        if named_apart(vecs, corpus.binaries):
            classes = semantic.Classes(tagged(vecs, corpus.binaries), min_similarity)
            if report:
                report(f"members of semantic classes: {classes.found.agg(F.sum('size')).first()[0] or 0}")
            return classes.members(results.class_numbers(classes.found, sort))
        members = phase(semantic.semantic_members(vecs, min_similarity), "semantic_members", "members of semantic classes")
    else:
        tree = written(structure.listed_trees(corpus.gathered(), min_depth), "tree_nodes")
        if report:
            report(f"candidate structures: {structural.candidates(tree, min_depth).count()}")
        members = phase(structural.structural_members(tree, min_depth, strict), "structural_members", "members of structural classes")
        if mode == "combined":
            vecs = written(vecs, "vectors")
            if named_apart(vecs, corpus.binaries):
                classes = combined.Classes(members.join(tags(corpus.binaries, "name"), "binary_id"), vecs, min_similarity)
                if report:
                    report(f"members of combined classes: {classes.found.agg(F.sum('size')).first()[0] or 0}")
                found = combined.deepest_classes(classes.found) if dedup else classes.found
                return classes.members(results.class_numbers(found, sort))
            members = phase(combined.combined_members(members, vecs, min_similarity), "combined_members", "members of combined classes")
    members = tagged(members, corpus.binaries)
    if dedup:
        members = results.deepest_only(written(members, "members"))
    return results.ranked(members, sort)
