"""A training corpus from ``documents``.

Documents that the quality rules reject go; of equal texts and of near copies
one stays; sources are mixed to their weights; what is left is packed into
sequences. Each stage is written as Parquet and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloneloom.llm import exact_dedup, mixing, ngram_join, packing, quality
from cloneloom.llm.common import table_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rule and the compression bands.

    Null and empty texts have no word and go; a very long text is judged whole.
    Repeated rows are judged alike, null ids and other nulls stay as they are;
    columns of any name are kept. An empty table stays empty.
    """
    return quality.accepted(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id.

    A null text equals an empty one; a null id is less than all. Of rows with
    the same id and text any one stays. Very long texts are compared whole, in
    chunks. Columns of any name are kept; an empty table stays empty.
    """
    return exact_dedup.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each class of near copies.

    Texts without a word, or null, are classes alone; a row with a null id
    stays. Rows that share an id stay or go together. Very long texts count
    with all their shingles. Columns of any name are kept; an empty table stays
    empty.
    """
    return ngram_join.one_per_class(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, up to three times.

    Null, empty and wordless texts are taken 0 times; null sources are one
    source. Of wholly repeated rows the first ones get the copies that not all
    can have. Columns of any name are kept; an empty table stays empty.
    """
    return mixing.mixed(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences and offsets.

    Null and empty texts have their end id only; very long ones are cut into
    full pieces and one shorter first one. Repeated rows, which the mix makes,
    are packed each; null ids are ids like others. Other columns are left out;
    an empty table stays empty.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mix_stage),
    ("best-fit packing", pack_stage),
]

#: SQL has no zstandard ratios, random rounding or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each stage but the last is written to the
    shared folder and read again, so a lost executor costs a part of a stage.
    Nulls, empty and long texts, ties, repeated rows and clashing columns are
    as the stages say; an empty table gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = table_path(spark, name.replace(" ", "_"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
