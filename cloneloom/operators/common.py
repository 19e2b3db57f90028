"""Helpers that operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: the one in ``spark.checkpoint.dir``.
    Where that is unset, a temporary one is used on a single machine; on a
    cluster it would be a different one on each, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="cloneloom-")
    return _own[app]


def settle(spark: SparkSession) -> None:
    """Switch off the partition-aware union of Spark 4.1: where the adaptive
    plan coalesces one side only, it zips unequal numbers of partitions and
    the query fails. Unions are then concatenations, as in earlier versions."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again, which cuts the
    lineage and keeps several readers from computing it several times."""
    spark = df.sparkSession
    settle(spark)
    path = f"{shared_dir(spark)}/cloneloom-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[Column], name: str, group: list[str] | None = None) -> DataFrame:
    """Add the row's place, from 0, in a total order, or in that of its group.

    Rows are dealt by ranges of group and order and numbered inside each
    range; each range starts after the rows of those before it. No task sees
    all rows, nor all of a hot group.
    """
    group = group or []
    dealt = rows.repartitionByRange(*map(F.col, group), *order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    counts = dealt.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"))
    # one row a range and group
    before = Window.partitionBy(*group).orderBy("_part")
    base = counts.select("_part", *group, (F.sum("_n").over(before) - F.col("_n")).alias("_base"))
    inside = Window.partitionBy("_part", *group).orderBy(*order)
    placed = dealt.withColumn("_place", F.row_number().over(inside) - 1)
    return placed.join(base, ["_part", *group]).withColumn(name, (F.col("_base") + F.col("_place")).cast("long")).drop("_part", "_base", "_place")


#: A group of more than this share of all rows is hot; there are at most
#: ``1 / HOT_SHARE`` of them, which bounds what is broadcast.
HOT_SHARE = 1 / 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str) -> DataFrame:
    """Inner join of rows with one row per group; ``groups`` is a written table
    with the number of rows of each in ``size``.

    Rows of hot groups stay where they are and meet their group's row by
    broadcast; all others go through an ordinary join.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(1, int(total * HOT_SHARE))
    hot, cold = groups.filter(F.col(size) > least), groups.filter(F.col(size) <= least)
    marked = rows.join(F.broadcast(hot.select(*key).withColumn("_hot", F.lit(True))), key, "left")
    in_hot = marked.filter("_hot").drop("_hot").join(F.broadcast(hot), key)
    in_cold = marked.filter("_hot is null").drop("_hot").join(cold, key)
    return in_hot.unionByName(in_cold)


def multiset(*columns: str) -> list[Column]:
    """Aggregates that fingerprint a group's rows whatever their order: their
    number and two sums of hashes. They combine before the shuffle, unlike
    collected lists, and take the same room for a group of any size."""
    sums = [F.sum(F.xxhash64(*columns, F.lit(seed)).cast("decimal(38,0)")).alias(f"_sum{seed}") for seed in (1, 2)]
    return [F.count(F.lit(1)).alias("_members"), *sums]


MULTISET = ["_members", "_sum1", "_sum2"]
