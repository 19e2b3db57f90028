"""Best-fit packing of documents into sequences of a fixed number of tokens.

Length-histogram planning: the packing is planned by best fit decreasing over
the counts of piece lengths (as many counts as a sequence has tokens, whatever
the corpus), then each piece takes its planned slot by its rank among the
pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import rank_in_groups, salts_for, written

CAPACITY = 1024

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Segment:
    """Pieces of ``length`` with ranks from ``rank``: ``each`` of them go to
    each sequence from ``sequence``, from ``offset`` on."""

    length: int
    rank: int
    count: int
    sequence: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Segment]:
    """Best fit decreasing over counts.

    Open sequences are held as ranges of numbers with the same room left, so
    the work depends on the number of lengths, not on that of the pieces. A
    sequence with room ``r`` is the tightest for a length, and stays it while
    it takes ``r // length`` of them; so a whole range is filled at once.
    """
    ranges: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    out: list[Segment] = []
    opened = 0

    def keep(room: int, low: int, high: int) -> None:
        if room and high > low:
            if room not in ranges:
                ranges[room] = []
                insort(rooms, room)
            ranges[room].append((low, high))

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit a sequence of {capacity}")
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                low, high = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[k]
            else:
                room, low = capacity, opened
                high = opened = low + -(-left // (capacity // length))
            each = room // length
            full = min(high - low, left // each)
            if full:
                out.append(Segment(length, rank, full * each, low, each, capacity - room))
                keep(room - each * length, low, low + full)
                rank, left, low = rank + full * each, left - full * each, low + full
            if left and low < high:
                out.append(Segment(length, rank, left, low, left, capacity - room))
                keep(room - left * length, low, low + 1)
                left, low = 0, low + 1
            keep(room, low, high)
    return out


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            rows: list[tuple] = []
            for k, own in tokens.encode(batch.column(1), path, end_id):
                at, short = 0, len(own) % capacity
                cuts = [short] if short else []
                cuts += [capacity] * (len(own) // capacity)
                for piece, n in enumerate(cuts):
                    rows.append((k, piece, at, n, zlib.crc32(np.ascontiguousarray(own[at : at + n], "<u4").tobytes())))
                    at += n
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.record_batch(
                [
                    ids.take(pa.array(cols[0], pa.int64())),
                    pa.array(cols[1], pa.int32()),
                    *(pa.array(c, pa.int64()) for c in cols[2:]),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = tokens.END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenize whole texts and cut those of more than ``capacity`` tokens.

    The first piece takes what the full pieces leave, so only one piece of a
    document isn't full. A null text has its end id only.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_pieces(tokenizer or tokens.default_tokenizer(), capacity, end_id), PIECES)


def pack(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces.

    ``length`` says how many tokens a piece has. The driver gets one count a
    length (``capacity`` of them at most) and broadcasts one row a length.
    Equal rows get slots of their own, other columns are kept unless they are
    called ``sequence_id``, ``offset``, ``slots`` or start with an underscore;
    an empty table stays empty.
    """
    spark = table.sparkSession
    histogram = {r[0]: r[1] for r in table.groupBy("length").count().collect()}
    by_length: dict[int, list[tuple]] = {}
    for s in plan(histogram, capacity):
        by_length.setdefault(s.length, []).append((s.rank, s.sequence, s.each, s.offset))
    slots = spark.createDataFrame(
        list(by_length.items()),
        "length long, slots array<struct<rank: long, sequence: long, each: long, offset: long>>",
    )
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in table.columns]
    ranked = rank_in_groups(table, ["length"], order, salts_for(sum(histogram.values())), "_rank")
    joined = ranked.join(F.broadcast(slots), "length")
    slot = F.element_at(F.filter("slots", lambda s: s["rank"] <= F.col("_rank")), -1)
    nth = F.col("_rank") - F.col("_slot.rank")
    return (
        joined.withColumn("_slot", slot)
        .withColumn("sequence_id", (F.col("_slot.sequence") + F.floor(nth / F.col("_slot.each"))).cast("long"))
        .withColumn("offset", (F.col("_slot.offset") + (nth % F.col("_slot.each")) * F.col("length")).cast("long"))
        .drop("slots", "_slot", "_rank")
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = tokens.END_ID) -> DataFrame:
    """Pieces of all documents with their sequences and offsets.

    Null and empty texts (their end id only), repeated rows and null ids are
    packed like others; ties between equal pieces are settled by some order,
    which no other result depends on. Very long texts are encoded whole and cut
    into full pieces. Columns other than ``doc_id`` and ``text`` are ignored,
    whatever their names; an empty table stays empty.
    """
    table = written(pieces(docs, tokenizer, capacity, end_id), "pieces")
    return pack(table, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
