"""Schemas and small dimensions of the clone-detection data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Addresses are unsigned 64-bit numbers.
ADDRESS = "decimal(20,0)"

SINK = 2**64 - 1
ENTRY = 0

#: Most functions are told apart by these two.
FUNCTION_KEY = ["binary_id", "function_id"]

BINARIES = "binary_id string, path string, arch string, bits int"
FUNCTIONS = f"binary_id string, function_id string, offset {ADDRESS}, name string"
STATEMENTS = f"binary_id string, function_id string, pos int, offset {ADDRESS}, family string, instruction string"
BLOCKS = f"binary_id string, function_id string, offset {ADDRESS}, length {ADDRESS}"
EDGES = f"binary_id string, function_id string, src {ADDRESS}, dst {ADDRESS}"
CFG_NODES = f"binary_id string, function_id string, offset {ADDRESS}, length {ADDRESS}, is_root boolean"
CFG_EDGES = f"binary_id string, function_id string, src {ADDRESS}, dst {ADDRESS}, pos int"
TREE_NODES = (
    "binary_id string, function_id string, node_id int, parent_id int, child_pos int, block_type string, depth int, "
    f"offset {ADDRESS}, struct_key string, strict_key string, basic_blocks array<struct<offset: {ADDRESS}, length: {ADDRESS}>>"
)

#: Labels of structure blocks.
BLOCK_TYPES = (
    "Basic", "SelfLooping", "Sequence", "IfThen", "IfThenElse", "While", "DoWhile", "Switch", "ProperInterval", "ImproperInterval",
)

# Statement families.
FAMILIES = (
    "abs", "add", "and", "call", "cast", "cjmp", "cmov", "cmp", "cpl", "crypto", "debug", "div", "fpu", "ill", "io", "jmp", "lea", "leave",
    "length", "load", "mask", "mod", "mov", "mul", "new", "nop", "nor", "not", "null", "or", "pop", "priv", "push", "ret", "rol", "ror", "sal",
    "sar", "shl", "shr", "store", "sub", "swi", "sync", "trap", "unk", "xchg", "xor",
)

# Other spellings of a family.
ALIASES = {
    "call": ("icall", "ircall", "ucall", "rcall", "ccall", "uccall"),
    "cjmp": ("rcjmp", "ucjmp", "mcjmp"),
    "cmp": ("acmp",),
    "jmp": ("ijmp", "irjmp", "ujmp", "mjmp", "rjmp"),
    "lea": ("ulea",),
    "push": ("rpush", "upush"),
    "ret": ("cret",),
    "swi": ("cswi",),
}

UNKNOWN_FAMILY = "unk"

# Bits of an architecture, None where the binary says.
ARCHITECTURES = {
    "arc": None, "avr": 8, "arm": None, "i4004": 4, "8051": None, "i8080": 8, "lm32": 32, "LH5801": 8, "6502": 8, "m68k": 32, "msp430": 16,
    "propeller": 32, "mips": None, "ppc": None, "riscv": None, "sparc": None, "v850": 32, "s390": None, "x86": None, "z80": 8,
}


def family_spellings() -> dict[str, str]:
    """Every accepted spelling and its family."""
    out = {f: f for f in FAMILIES}
    out.update({a: f for f, names in ALIASES.items() for a in names})
    return out


def family_table(spark: SparkSession) -> DataFrame:
    """(spelling, family): a fixed dimension of a few dozen rows."""
    return spark.createDataFrame(sorted(family_spellings().items()), "spelling string, family string")


def architecture_table(spark: SparkSession) -> DataFrame:
    """(arch, fixed_bits): a fixed dimension of twenty rows."""
    return spark.createDataFrame(sorted(ARCHITECTURES.items()), "arch string, fixed_bits int")
