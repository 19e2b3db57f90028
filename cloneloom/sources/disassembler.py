"""Runs an external disassembler over binaries, where one is installed.

Extraction is an ordinary job of its own: one task a binary, whose output is
a dump table to be written once and analysed many times.
"""

from __future__ import annotations

import json
import os
import shutil
import subprocess
import threading

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .dumps import DUMPS

# Commands of the disassembler.
INFO, OFFSETS, NAMES, BODY, BLOCKS, EDGES = "ij", "aflqj", "aflj", "pdfj", "afb", "agfdm"
FULL_ANALYSIS, BOUNDS_ANALYSIS = ("aaa",), ("aa", "aac")


#: What parts the outputs of two commands.
MARK = "---8<---"


class Session:
    """A disassembler that reads commands from a pipe, so that any number of
    them can follow one analysis. ``timeout`` bounds the analysis alone."""

    def __init__(self, tool: str, path: str):
        self.process = subprocess.Popen(
            [tool, "-2", "-q0", path], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, encoding="utf-8", errors="replace"
        )

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *_) -> None:
        self.process.kill()
        self.process.stdin.close()
        self.process.stdout.close()
        self.process.wait()

    def ask(self, command: str, timeout: float | None = None) -> str:
        """A command's output. One command is answered before the next is
        sent, so neither pipe fills up."""
        late = threading.Event()

        def stop() -> None:
            late.set()
            self.process.kill()

        timer = threading.Timer(timeout, stop) if timeout else None
        if timer:
            timer.start()
        try:
            self.process.stdin.write(f"{command}\n?e {MARK}\n")
            self.process.stdin.flush()
            lines = []
            for line in self.process.stdout:
                line = line.replace("\0", "")
                if line.rstrip("\r\n") == MARK:
                    return "".join(lines).strip("\n")
                lines.append(line)
        except BrokenPipeError:
            pass
        finally:
            if timer:
                timer.cancel()
        if late.is_set():
            raise subprocess.TimeoutExpired(command, timeout)
        raise ValueError(f"the disassembler ended at {command}")


def extract_one(path: str, tool: str = "r2", full: bool = True, timeout: float | None = None) -> list[tuple]:
    """Dump rows of one binary, which is analysed once. A file that can't be
    read is a FileNotFoundError, a missing tool a BrokenPipeError; a binary
    without a known architecture has its information only. ``timeout`` seconds
    bound the analysis, not what is listed after it."""
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    if not shutil.which(tool):
        raise BrokenPipeError(f"{tool} can't be started")
    with Session(tool, path) as session:
        rows = [(path, None, INFO, session.ask(INFO))]
        session.ask("; ".join(FULL_ANALYSIS if full else BOUNDS_ANALYSIS), timeout)
        names = session.ask(NAMES)
        rows.append((path, None, NAMES, names))
        for f in json.loads(names or "[]"):
            if "offset" in f and "name" in f:
                rows += [(path, f["name"], command, session.ask(f"{command} @ {f['offset']}")) for command in (BODY, BLOCKS, EDGES)]
    return rows


def extract(spark: SparkSession, paths: DataFrame, tool: str = "r2", full: bool = True, timeout: float | None = None) -> DataFrame:
    """Dumps of the binaries in (path); one that fails, or whose analysis takes
    longer than ``timeout`` seconds, gives a row with command ``error``."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    rows = extract_one(path, tool, full, timeout)
                except (OSError, subprocess.TimeoutExpired, ValueError) as error:
                    rows = [(path, None, "error", f"{type(error).__name__}: {error}")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["binary_id", "function_id", "command", "output"])

    return paths.select("path").repartition("path").mapInArrow(run, DUMPS)
