"""Disassembly dumps: JSON and text that a disassembler wrote.

A dump table holds one row for each command's output: (binary_id, function_id
or null, command, output). All parsers are column expressions; rows that lack
an expected field are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import statements as S
from ..model import ADDRESS, FUNCTION_KEY, architecture_table

KEY = FUNCTION_KEY

DUMPS = "binary_id string, function_id string, command string, output string"

_OPS = f"array<struct<offset: {ADDRESS}, type: string, opcode: string>>"


def architectures(dumps: DataFrame, output: str = "output") -> DataFrame:
    """(binary_id, arch, bits) of binary information; binaries of an unknown
    architecture or without one drop out."""
    rows = dumps.select("binary_id", F.get_json_object(output, "$.bin.arch").alias("arch"), F.get_json_object(output, "$.bin.bits").cast("int").alias("bits"))
    return S.with_bits(rows.filter(F.col("arch").isNotNull() & F.col("bits").isNotNull()))


def known_architectures(spark) -> DataFrame:
    return architecture_table(spark)


def function_offsets(dumps: DataFrame, output: str = "output") -> DataFrame:
    """(binary_id, offset), each once, of arrays of offsets."""
    return dumps.select("binary_id", F.explode(F.from_json(output, f"array<{ADDRESS}>")).alias("offset")).filter("offset is not null").distinct()


def function_names(dumps: DataFrame, output: str = "output") -> DataFrame:
    """(binary_id, name, offset) of function lists; the last of a name wins."""
    rows = dumps.select("binary_id", F.posexplode(F.from_json(output, f"array<struct<offset: {ADDRESS}, name: string>>")).alias("pos", "f"))
    rows = rows.filter("f.offset is not null and f.name is not null")
    return rows.groupBy("binary_id", F.col("f.name").alias("name")).agg(F.max_by("f.offset", "pos").alias("offset"))


def _bodies(dumps: DataFrame, ops: Column) -> DataFrame:
    rows = dumps.select(*KEY, F.posexplode(ops).alias("pos", "op")).filter("op.offset is not null and op.type is not null and op.opcode is not null")
    rows = rows.select(*KEY, "pos", F.col("op.offset").alias("offset"), "op.type", S.instruction(F.col("op.opcode")).alias("instruction"))
    return S.with_family(rows, "type").select(*KEY, "pos", "offset", "family", "instruction")


def block_bodies(dumps: DataFrame, output: str = "output") -> DataFrame:
    """Statements of basic blocks: arrays of operations."""
    return _bodies(dumps, F.from_json(output, _OPS))


def function_bodies(dumps: DataFrame, output: str = "output") -> DataFrame:
    """Statements of functions: objects with their operations in ``ops``."""
    return _bodies(dumps, F.from_json(output, f"ops {_OPS}")["ops"])


def _address(text: Column) -> Column:
    return F.when(F.lower(text).startswith("0x"), S.number(F.lower(text)))


def _quoted(text: Column) -> Column:
    """What stands in the double quotes that are all of the text, or null."""
    bare = F.trim(text)
    return F.when(bare.startswith('"') & bare.endswith('"'), F.replace(bare, F.lit('"'), F.lit("")))


def _lines(dumps: DataFrame, output: str) -> DataFrame:
    return dumps.select(*KEY, F.explode(F.split(output, "\r?\n")).alias("line"))


def text_edges(dumps: DataFrame, output: str = "output") -> DataFrame:
    """(key, src, dst) of lines like ``"0x10" -> "0x20"``; attributes may
    follow in brackets."""
    ends = F.split(F.split_part("line", F.lit("["), F.lit(1)), "->")
    rows = _lines(dumps, output).withColumn("ends", ends).filter(F.size("ends") == 2)
    rows = rows.select(*KEY, *(_address(_quoted(F.rtrim(F.get("ends", F.lit(k)), F.lit("; ")))).alias(name) for k, name in enumerate(("src", "dst"))))
    return rows.filter("src is not null and dst is not null")


def text_blocks(dumps: DataFrame, output: str = "output") -> DataFrame:
    """(key, offset, length) of lines that start with an address and have the
    length in their fourth field."""
    rows = _lines(dumps, output).select(*KEY, F.split(F.trim("line"), "[ \t]+").alias("fields")).filter(F.size("fields") > 3)
    rows = rows.select(*KEY, _address(F.get("fields", F.lit(0))).alias("offset"), F.get("fields", F.lit(3)).alias("length"))
    length = F.when(F.col("length").rlike("^[0-9]+$"), S.number(F.col("length")))
    return rows.withColumn("length", length).filter("offset is not null and length is not null")


def function_graphs(block_dumps: DataFrame, edge_dumps: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, edges, roots) of functions that have both; the root is the
    function's offset. ``functions``: (key, offset)."""
    blocks, edges = text_blocks(block_dumps), text_edges(edge_dumps)
    both = blocks.select(*KEY).distinct().join(edges.select(*KEY).distinct(), KEY, "left_semi")
    roots = functions.select(*KEY, F.col("offset").alias("root")).join(both, KEY, "left_semi")
    return blocks.join(both, KEY, "left_semi"), edges.join(both, KEY, "left_semi"), roots
