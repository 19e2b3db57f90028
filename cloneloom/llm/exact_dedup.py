"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of a byte string is its polynomial at a fixed point modulo two
primes. ``fp(AB) = fp(A) * r**len(B) + fp(B)``, so chunks of a huge document
are hashed on their own and combined by length-shifted arithmetic. Documents
with equal fingerprints are then compared, chunk by chunk, with the one that
stays; a document that differs gets a group of its own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, text_of, written

#: Bytes hashed by one dot product: 2**8 * 2**31 * CHUNK stays under 2**63.
CHUNK = 1 << 14

#: Characters compared at once.
COMPARE_CHARS = 1 << 16

#: Members compared with one copy of the document that stays.
MEMBERS_PER_COPY = 256

# Two primes under 2**31 and a point for each.
PRIMES = (2147483647, 2147483629)
POINTS = (1103515245, 1664525069)


def _powers(point: int, prime: int) -> np.ndarray:
    out = np.ones(CHUNK, np.uint64)
    for k in range(1, CHUNK):
        out[k] = int(out[k - 1]) * point % prime
    return out[::-1].copy()


_tables: list[np.ndarray] = []


def combine(left: int, right: int, right_length: int, which: int) -> int:
    """Fingerprint of a concatenation from those of its two parts."""
    prime = PRIMES[which]
    return (left * pow(POINTS[which], right_length, prime) + right) % prime


def fingerprint(data: np.ndarray) -> int:
    """62-bit fingerprint of bytes (each counts as its value plus one)."""
    if not _tables:
        _tables.extend(_powers(r, p) for r, p in zip(POINTS, PRIMES, strict=True))
    parts = [0, 0]
    for at in range(0, len(data), CHUNK):
        chunk = data[at : at + CHUNK].astype(np.uint64) + np.uint64(1)
        for k in (0, 1):
            own = int(np.dot(chunk, _tables[k][CHUNK - len(chunk) :])) % PRIMES[k]
            parts[k] = combine(parts[k], own, len(chunk), k)
    return parts[0] << 31 | parts[1]


def _fingerprints(batches):
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        texts = texts if pa.types.is_large_string(texts.type) else texts.cast(pa.large_string())
        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else [0]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        marks = [fingerprint(data[bounds[k] : bounds[k + 1]]) for k in range(n)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(marks, pa.int64()), pa.array(np.diff(bounds), pa.int64())],
            names=[*batch.schema.names, "fp", "n_bytes"],
        )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_sha256, text, fp, n_bytes) of whole texts; null: empty."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.sha2(text_of(text_col), 256).alias("text_sha256"), text_of(text_col).alias("text")
    )
    return rows.mapInArrow(_fingerprints, "doc_id long, text_sha256 string, text string, fp long, n_bytes long")


KEY = ["fp", "n_bytes"]


def _chunks(rows: DataFrame, *keep: str) -> DataFrame:
    """One row for each ``COMPARE_CHARS`` characters, an empty text having one."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - 1), F.lit(COMPARE_CHARS))
    cut = F.transform(starts, lambda s: F.substring(F.col("text"), s + 1, F.lit(COMPARE_CHARS)))
    return rows.select(*keep, F.posexplode(cut).alias("chunk_no", "chunk"))


def differing(texts: DataFrame) -> DataFrame:
    """(fp, n_bytes, text_sha256) of texts that aren't their group's text.

    ``texts`` holds the members (with text, ``keep_id`` and ``group_size``) of
    groups of two or more. The text that stays is copied once for every
    ``MEMBERS_PER_COPY`` members, so that no task compares a whole hot group.
    """
    copies = F.ceil(F.col("group_size") / MEMBERS_PER_COPY)
    keep = texts.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    keep = keep.select(*KEY, "group_size", "text_sha256", "text").dropDuplicates([*KEY, "text_sha256"])
    keep = keep.groupBy(*KEY).agg(F.min_by(F.struct("group_size", "text"), "text_sha256").alias("k"))
    keep = keep.select(*KEY, "k.*").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    members = texts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "text_sha256"), copies))
    at = [*KEY, "_salt", "chunk_no"]
    left = _chunks(members, *KEY, "_salt", "text_sha256")
    right = _chunks(keep, *KEY, "_salt").withColumnRenamed("chunk", "kept_chunk")
    return left.join(right, at).filter(F.col("chunk") != F.col("kept_chunk")).select(*KEY, "text_sha256").distinct()


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null counts as empty. Of equal texts the
    row with the largest id stays (a null id only if all are null). Repeated
    rows with the same id and text form a group too; one of them stays, and as
    ``kept`` can't tell them apart, both say true. A very long text is hashed in
    chunks and compared in chunks. Other columns are ignored, whatever their
    names. An empty table stays empty.
    """
    marks = written(fingerprints(docs, id_col, text_col).drop("text"), "fingerprints")
    n_rows = marks.count()
    groups = marks.groupBy(*KEY).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups, "fingerprint_groups")
    several = groups.filter("group_size > 1")
    members = written(join_groups(fingerprints(docs, id_col, text_col), several, KEY, "group_size", n_rows, "merge"), "members")
    odd = written(differing(members), "differing")
    if odd.isEmpty():
        single = groups.filter("group_size = 1").select(*KEY)
        alone = marks.join(single, KEY, "left_semi").withColumn("keep_id", F.col("doc_id")).withColumn("group_size", F.lit(1).cast("long"))
        shared = join_groups(marks, several, KEY, "group_size", n_rows)
        out = alone.unionByName(shared)
    else:
        own = marks.join(odd.withColumn("_own", F.col("text_sha256")), [*KEY, "text_sha256"], "left").fillna("", ["_own"])
        fine = own.groupBy(*KEY, "_own").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = join_groups(own, written(fine, "groups"), [*KEY, "_own"], "group_size", n_rows)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their
    names.

    Of equal texts the row with the largest id stays, a null counting as empty
    text and a null id as less than all; of rows with the same id and text any
    one stays. Texts of any length are compared whole. An empty table stays
    empty.
    """
    groups = written(exact_groups(docs, id_col, text_col), "exact_groups")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.sha2(text_of(text_col), 256).alias("sha"))

    def same(other: DataFrame):
        return F.col("id").eqNullSafe(other["_id"]) & (F.col("sha") == other["_sha"])

    def named(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))

    dropped = named(groups.filter("not kept")).distinct()
    out = rows.join(dropped, same(dropped), "left_anti")
    twice = groups.filter("kept and group_size > 1").groupBy("doc_id", "text_sha256").count().filter("count > 1")
    twice = written(named(twice), "repeated_rows")
    if not twice.isEmpty():
        once = out.join(twice, same(twice), "left_semi").dropDuplicates(["id", "sha"])
        out = out.join(twice, same(twice), "left_anti").unionByName(once)
    return out.select("row.*")
