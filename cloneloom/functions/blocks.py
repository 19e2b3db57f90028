"""Basic blocks and structure blocks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import ADDRESS, ENTRY, SINK


def address(value: int) -> Column:
    return F.lit(str(value)).cast(ADDRESS)


def block(offset: Column, length: Column) -> Column:
    return F.struct(offset.cast(ADDRESS).alias("offset"), length.cast(ADDRESS).alias("length"))


def new_sink() -> Column:
    return block(address(SINK), address(0))


def new_entry_point() -> Column:
    return block(address(ENTRY), address(0))


def is_sink(offset: Column, length: Column) -> Column:
    return (offset == address(SINK)) & (length == 0)


def is_entry_point(offset: Column, length: Column) -> Column:
    return (offset == address(ENTRY)) & (length == 0)


def kind(offset: Column, length: Column) -> Column:
    return F.when(is_sink(offset, length), "sink").when(is_entry_point(offset, length), "entry").otherwise("real")


def hexadecimal(offset: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.conv(offset.cast("string"), 10, 16)))


def block_list(blocks: Column) -> Column:
    """Offsets of an array of blocks in hexadecimal, sorted, without sinks."""
    real = F.filter(F.sort_array(blocks), lambda b: ~is_sink(b["offset"], b["length"]))
    return F.concat_ws(",", F.transform(real, lambda b: hexadecimal(b["offset"])))


def title(block_type: Column, offset: Column) -> Column:
    """A nested block's name, or a basic block's offset."""
    return F.when(block_type == "Basic", offset.cast("string")).otherwise(F.concat_ws("_", block_type, offset.cast("string")))
