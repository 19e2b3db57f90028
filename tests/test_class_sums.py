"""Classes as sums that are made where vectors meet."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cloneloom import queries
from cloneloom.operators import combined, results, semantic, vectors
from cloneloom.operators.common import written
from cloneloom.plans import detect


def refuse(*_):
    raise AssertionError("pairs of similar vectors are listed")


def some_vectors(spark):
    """Few and many opcodes, equal vectors, multiples, and a vector alone."""
    rng, rows = random.Random(5), []
    for f in range(150):
        words = "pqrs" if f < 100 else [f"w{k}" for k in range(300)]
        own = [(w, rng.randint(1, 4)) for w in rng.sample(words, 3 if f < 100 else 200)]
        rows += [("x", str(f), w, n) for w, n in own]
        if f % 10 == 0:
            rows += [("x", str(1000 + f), w, n) for w, n in own] + [("x", str(2000 + f), w, 2 * n) for w, n in own]
    rows.append(("x", "3000", "alone", 1))
    counts = spark.createDataFrame(rows, "binary_id string, function_id string, opcode string, n long")
    return vectors.vectors(counts)


@pytest.mark.parametrize("most", [8, 4096])
def test_semantic_sums(spark, monkeypatch, most):
    vecs = some_vectors(spark)
    value = F.col("function_id").cast("long")
    want = queries._digests(semantic.semantic_members(vecs, 0.8), value)
    monkeypatch.setattr(vectors, "WIDE_TILE", most)
    monkeypatch.setattr(semantic, "similar_vectors", refuse)
    got = semantic.semantic_digests(vecs, value, 0.8)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    assert got.columns == want.columns


@pytest.mark.parametrize("name", ["semantic_classes", "combined_classes"])
def test_no_pairs_are_listed(spark, data_dir, monkeypatch, name):
    monkeypatch.setattr(semantic, "similar_vectors", refuse)
    monkeypatch.setattr(combined, "similar_vectors", refuse)
    assert queries.QUERIES[name](spark, data_dir).count() > 0


@pytest.mark.parametrize("sort, most, share", [("size-desc", 64, 1), ("size-asc", 4096, 4096)])
def test_detection_lists_members_last(spark, monkeypatch, sort, most, share):
    """Pairs, neighbourhoods and members were written several times each."""
    rows = some_vectors(spark).select("binary_id", "function_id", F.explode("vec").alias("x"))
    rows = rows.select("binary_id", "function_id", F.col("x.opcode").alias("family"), F.explode(F.sequence(F.lit(1), F.col("x.n"))).alias("pos"))
    binaries = spark.createDataFrame([("x", "/x", "x86", 64), ("y", "/y", "x86", 64)], "binary_id string, path string, arch string, bits int")
    corpus = detect.Corpus(binaries, written(rows, "statements"))
    names = ["clone_class_id", "class_depth", "size", "binary_id", "function_id"]
    found = lambda: Counter(map(tuple, detect.detect_clones(corpus, "semantic", min_similarity=0.8, sort=sort).select(names).collect()))
    with monkeypatch.context() as patched:
        patched.setattr(detect, "named_apart", lambda *_: False)
        want = found()
    monkeypatch.setattr(vectors, "WIDE_TILE", most)
    monkeypatch.setattr(semantic, "SHARE", share)
    monkeypatch.setattr(semantic, "similar_vectors", refuse)
    assert found() == want and len(want) > 1000


def test_names_that_clash_are_not_apart(spark):
    vecs = spark.createDataFrame([("x",), ("y",)], "binary_id string")
    apart = lambda *rows: detect.named_apart(vecs, spark.createDataFrame(rows, "binary_id string, path string, arch string, bits int"))
    assert apart(("x", "/x", "x86", 64), ("y", "/y", "x86", 64))
    assert not apart(("x", "/x", "x86", 64), ("y", "/x", "x86", 64))
    assert not apart(("x", "/x", "x86", 64))


def test_combined_detection_lists_members_last(spark, data_dir, monkeypatch):
    """All members were written twice, and told apart by their hashes."""
    corpus = queries.shape_corpus(spark, data_dir)
    names = ["class_key", "clone_class_id", "class_depth", "size", "binary_id", "function_id", "node_id", "depth", "basic_blocks"]
    found = lambda: Counter(map(repr, detect.detect_clones(corpus, "combined", 2, 0.9, sort="size-desc").select(names).collect()))
    with monkeypatch.context() as patched:
        patched.setattr(detect, "named_apart", lambda *_: False)
        want = found()
    for place, name in ((combined, "combined_members"), (results, "deepest_only"), (results, "ranked")):
        monkeypatch.setattr(place, name, refuse)
    monkeypatch.setattr(combined, "SHARE", 1)
    monkeypatch.setattr(combined, "HOT_SHARE", 0)
    assert found() == want and len(want) > 100


def test_vectors_of_functions_are_not_broadcast(spark):
    """A million functions with a few vectors are a file of a few MB, which
    the driver gathered and broadcast."""
    vecs = written(some_vectors(spark), "vectors")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    members = vecs.select(F.lit("k").alias("class_key"), "binary_id", "function_id", F.lit(0).alias("node_id"), F.lit(1).alias("depth"), F.lit("x").alias("name"))
    plan = combined.Classes(members, vecs, 0.9).rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
