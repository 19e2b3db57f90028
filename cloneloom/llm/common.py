"""Helpers that the training-data operators share: written stage tables,
ranks within groups and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A group is hot when it holds more than this share of all rows; at most
#: ``1 / HOT_SHARE`` groups can be hot, which bounds what is broadcast.
HOT_SHARE = 1 / 1000

#: Rows that one (group, salt) window partition should hold at most.
ROWS_PER_SALT = 500_000

#: Fewest salts; enough to spread one hot group over a small cluster.
MIN_SALTS = 64

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can read and write.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and there is one machine (tests) a temporary folder of it is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="cloneloom-")
    return _own_dirs[app]


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cloneloom-{uuid.uuid4().hex}/{name}"


def settle(spark: SparkSession) -> None:
    """Switch off the partition-aware union of Spark 4.1: where the adaptive
    plan coalesces one side only, it zips unequal numbers of partitions and
    the query fails. Unions are then concatenations, as in earlier versions."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    It cuts the lineage: what is lost with an executor is read again from the
    shared folder, and several readers don't compute ``df`` several times.
    """
    spark = df.sparkSession
    settle(spark)
    path = table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salts_for(rows: int) -> int:
    return max(MIN_SALTS, -(-rows // ROWS_PER_SALT))


def rank_in_groups(table: DataFrame, group: list[str], order: list[str], salts: int, name: str) -> DataFrame:
    """Add ``name``: the row's place (from 0, gapless) among its group's rows.

    Rows of one group are dealt over ``salts`` windows by a hash of ``order``
    and each window gets the rows of the windows before it as its base, so no
    group meets in one task. ``table`` is read twice and should be a written
    table. Equal rows get different places.
    """
    salted = table.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    keys = [*group, "_salt"]
    counts = salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    here = Window.partitionBy(*keys).orderBy(*order)
    local = salted.withColumn("_place", F.row_number().over(here) - 1)
    return local.join(base, keys).withColumn(name, (F.col("_base") + F.col("_place")).cast("long")).drop("_salt", "_base", "_place")


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str, n_rows: int, hint: str | None = None) -> DataFrame:
    """Inner join of ``rows`` with one row per group.

    Groups of more than ``HOT_SHARE`` of all rows are at most
    ``1 / HOT_SHARE``, so they are broadcast and their rows stay where they
    are; all others go through an ordinary join, for which ``hint`` can name
    the strategy.
    """
    least = max(1, int(n_rows * HOT_SHARE))
    hot = groups.filter(F.col(size) > least)
    cold = groups.filter(F.col(size) <= least)
    hot_keys = hot.select(*key).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot_keys), key, "left")
    in_hot = marked.filter(F.col("_hot")).drop("_hot").join(F.broadcast(hot), key)
    in_cold = marked.filter(F.col("_hot").isNull()).drop("_hot").join(cold.hint(hint) if hint else cold, key)
    return in_hot.unionByName(in_cold)


def text_of(column: str = "text") -> Column:
    """The text, a null counting as empty."""
    return F.coalesce(F.col(column), F.lit(""))
