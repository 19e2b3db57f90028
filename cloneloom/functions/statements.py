"""Statements, families, architectures and jumps as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import ADDRESS, UNKNOWN_FAMILY, architecture_table, family_table

NO_JUMP = "NoJump"
JUMP_COND = "JumpConditional"
JUMP_UNCOND = "JumpUnconditional"
RET_COND = "RetConditional"
RET_UNCOND = "RetUnconditional"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Condition codes that an ARM mnemonic can end with.
ARM_CONDITIONS = ("eq", "ne", "cs", "hs", "cc", "lo", "mi", "pl", "vs", "vc", "hi", "ls", "ge", "gt", "lt", "le")


def instruction(raw: Column) -> Column:
    """ASCII lower case without white space around it."""
    return F.regexp_replace(F.translate(raw, _UPPER, _LOWER), r"^\s+|\s+$", "")


def mnemonic(instr: Column) -> Column:
    """What stands before the first space, or all of it."""
    return F.substring_index(instr, " ", 1)


def arguments(instr: Column) -> Column:
    """What stands after the first space, or nothing."""
    at = F.instr(instr, " ")
    return F.when(at > 0, F.substring(instr, at + 1, F.length(instr))).otherwise("")


def with_family(rows: DataFrame, column: str, name: str = "family") -> DataFrame:
    """Add the family of a spelling; unknown ones are ``unk``."""
    table = F.broadcast(family_table(rows.sparkSession).withColumnRenamed("family", "_family"))
    joined = rows.join(table, rows[column] == table["spelling"], "left").drop("spelling")
    return joined.withColumn(name, F.coalesce("_family", F.lit(UNKNOWN_FAMILY))).drop("_family")


def with_bits(rows: DataFrame, arch: str = "arch", bits: str = "bits") -> DataFrame:
    """Keep rows of known architectures, with the bits fixed by those that
    have only one width."""
    table = F.broadcast(architecture_table(rows.sparkSession).withColumnRenamed("arch", "_arch"))
    joined = rows.join(table, rows[arch] == table["_arch"]).drop("_arch")
    return joined.withColumn(bits, F.coalesce("fixed_bits", F.col(bits)).cast("int")).drop("fixed_bits")


def without_condition(name: Column) -> Column:
    """An ARM mnemonic without its condition and the dot before it."""
    codes = "|".join(ARM_CONDITIONS)
    return F.regexp_replace(name, rf"^(?=.{{3}})(.*?)\.?(?:{codes})$", "$1")


def jump_x86(name: Column) -> Column:
    return (
        F.when(name == "ret", RET_UNCOND)
        .when(name == "jmp", JUMP_UNCOND)
        .when(name.startswith("j"), JUMP_COND)
        .otherwise(NO_JUMP)
    )


def jump_arm(name: Column) -> Column:
    bare = without_condition(name)
    conditional = bare != name
    return (
        F.when(bare == "b", F.when(conditional, JUMP_COND).otherwise(JUMP_UNCOND))
        .when(bare == "bx", F.when(conditional, RET_COND).otherwise(RET_UNCOND))
        .otherwise(NO_JUMP)
    )


def jump(arch: Column, name: Column) -> Column:
    """The kind of jump; null for architectures whose jumps aren't known."""
    return F.when(arch == "x86", jump_x86(name)).when(arch == "arm", jump_arm(name))


def number(text: Column) -> Column:
    """An unsigned 64-bit number, hexadecimal after 0x, octal after 0o, binary
    after 0b, else decimal; null if it is none."""
    clean = F.regexp_replace(text, "_", "")
    radix = [("0x", 16, "^0[xX][0-9a-fA-F]{1,16}$"), ("0o", 8, "^0[oO][0-7]{1,21}$"), ("0b", 2, "^0[bB][01]{1,64}$")]
    whole = F.when(clean.rlike(r"^\+?[0-9]{1,20}$"), F.regexp_replace(clean, r"\+", "").cast(ADDRESS))
    tagged = reduce(lambda e, r: e.when(clean.rlike(r[2]), F.conv(F.substring(clean, 3, 64), r[1], 10).cast(ADDRESS)), radix[1:], F.when(clean.rlike(radix[0][2]), F.conv(F.substring(clean, 3, 64), 16, 10).cast(ADDRESS)))
    found = F.coalesce(tagged, whole)
    return F.when(found <= F.lit(str(2**64 - 1)).cast(ADDRESS), found)


def tag(arch: Column, bits: Column, path: Column) -> Column:
    return F.format_string("[%s_%d]%s", arch, bits, path)


_TAG = r"^\[([^_\]]*)_([^\]]*)\](.*)$"


def untag(tagged: Column) -> tuple[Column, Column, Column]:
    """Architecture, bits and path of a tagged name."""
    return tuple(F.regexp_extract(tagged, _TAG, k) for k in (1, 2, 3))


def parse(rows: DataFrame, raw: str = "instruction", arch: Column | None = None) -> DataFrame:
    """Add instruction, mnemonic, args and, for an architecture, jump."""
    out = rows.withColumn("instruction", instruction(F.col(raw)))
    out = out.withColumn("mnemonic", mnemonic(F.col("instruction"))).withColumn("args", arguments(F.col("instruction")))
    return out if arch is None else out.withColumn("jump", jump(arch, F.col("mnemonic")))
