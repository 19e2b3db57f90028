"""python -m cloneloom: clone classes of a folder of dumps.

The folder holds Parquet tables: ``binaries`` and, as the mode needs them,
``statements``, ``blocks``, ``edges``, ``roots``; or ``dumps``, from which
they are made.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import results
from .plans.detect import Corpus, detect_clones
from .sources import disassembler, dumps


def corpus_of_dumps(table: DataFrame) -> Corpus:
    of = lambda command: table.filter(F.col("command") == command)
    arch = dumps.architectures(of(disassembler.INFO))
    binaries = arch.select("binary_id", F.col("binary_id").alias("path"), "arch", "bits")
    names = dumps.function_names(of(disassembler.NAMES)).select("binary_id", F.col("name").alias("function_id"), "offset")
    blocks, edges, roots = dumps.function_graphs(of(disassembler.BLOCKS), of(disassembler.EDGES), names)
    return Corpus(binaries, dumps.function_bodies(of(disassembler.BODY)), blocks, edges, roots)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="cloneloom", description="Finds clones of functions across binaries.")
    p.add_argument("input", nargs="+", help="folders of Parquet tables, or binaries with --extract")
    p.add_argument("-a", "--architecture", choices=["same", "cross"], help="compare mnemonics or families; else by the binaries' architectures")
    p.add_argument("-m", "--min-depth", type=int, default=3)
    p.add_argument("--min-similarity", type=float, default=0.99)
    p.add_argument("-b", "--basic-blocks", action="store_true")
    p.add_argument("-c", "--csv", nargs="?", const="-", metavar="FOLDER", help="CSV instead of the text report, as files in a folder or on the standard output")
    p.add_argument("--disable-structural", action="store_true")
    p.add_argument("--disable-semantic", action="store_true")
    p.add_argument("-s", "--sort", choices=results.SORTS, default="none")
    p.add_argument("--no-filter", action="store_true")
    p.add_argument("-l", "--limit", type=int, help="binaries extracted at a time")
    p.add_argument("-t", "--timeout", type=float, help="seconds for the analysis of a binary")
    p.add_argument("--extract", action="store_true", help="inputs are binaries; needs the disassembler")
    p.add_argument("--compat-autodetect", action="store_true")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("cloneloom").getOrCreate()
    began = time.perf_counter()

    def report(line: str) -> None:
        print(f"{time.perf_counter() - began:9.3f} s  {line}", file=sys.stderr)

    if a.extract:
        from .operators.common import written

        paths = spark.createDataFrame([(x,) for x in a.input], "path string").repartition(a.limit or len(a.input))
        corpus = corpus_of_dumps(written(disassembler.extract(spark, paths, timeout=a.timeout), "dumps"))
    else:

        def table(name: str) -> DataFrame | None:
            found = []
            for folder in a.input:
                try:
                    found.append(spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))
                except Exception as error:  # a table that isn't there
                    if "PATH_NOT_FOUND" not in str(error):
                        raise
            if not found:
                return None
            out = found[0]
            for more in found[1:]:
                out = out.unionByName(more)
            return out

        dump = table("dumps")
        names = ("binaries", "statements", "blocks", "edges", "roots")
        corpus = corpus_of_dumps(dump) if dump is not None else Corpus(*(table(n) for n in names))
    if a.disable_semantic and a.disable_structural:
        members = None
    else:
        mode = "structural" if a.disable_semantic else "semantic" if a.disable_structural else "combined"
        members = detect_clones(
            corpus, mode, a.min_depth, a.min_similarity, a.architecture or "auto", a.sort, not a.no_filter, compat_autodetect=a.compat_autodetect, report=report
        )
    if members is None:
        print("----------------------------\nClasses: 0 Clones: 0")
    elif a.csv == "-":
        for line in results.csv_lines(members, a.basic_blocks):
            print(line)
    elif a.csv:
        results.write_csv(members, a.csv, a.basic_blocks)
    else:
        for line in results.text_lines(members, a.basic_blocks):
            print(line)
    report("done")
    return 0


if __name__ == "__main__":
    sys.exit(main())
