"""Quality rules: base counts and compression bands.

zstandard ratios (compressed by raw bytes) of the whole text and of fixed
chunks must lie inside a band that depends on the text's length: repetitive
text falls under it, text that no compressor shortens (keys, random or packed
data) rises over it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

LEVEL = 3


@dataclass(frozen=True)
class Bands:
    """``whole``: (least bytes, lowest ratio, highest ratio) by rising length;
    the last that a text reaches holds. From 128 to 4095 bytes the highest
    ratio lies between clean prose and random base64 of the length; shorter
    texts don't tell them apart. A text is rejected, too, if more than
    ``bad_share`` of its bytes are in chunks outside ``chunk_low`` and
    ``chunk_high``, or in a tail outside the band of the tail's length."""

    whole: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, float("inf")),
        (64, 0.40, 1.30),
        (128, 0.34, 0.955),
        (160, 0.34, 0.94),
        (192, 0.34, 0.885),
        (256, 0.30, 0.82),
        (384, 0.30, 0.78),
        (512, 0.30, 0.75),
        (768, 0.30, 0.71),
        (1024, 0.24, 0.68),
        (1536, 0.24, 0.66),
        (2048, 0.24, 0.65),
        (4096, 0.20, 0.72),
        (16384, 0.16, 0.70),
    )
    chunk_bytes: int = 2048
    chunk_low: float = 0.20
    chunk_high: float = 0.74
    bad_share: float = 0.34


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "zstd_ratio double, bad_chunk_share double, base_failed boolean, kept boolean"
)

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeats(hashes: np.ndarray, row: np.ndarray, later: bool) -> np.ndarray:
    """Which entries equal another of their row (an earlier one, if ``later``)."""
    out = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        order = np.lexsort((np.arange(len(hashes)), hashes, row)) if later else np.lexsort((hashes, row))
        h, r = hashes[order], row[order]
        same = (h[1:] == h[:-1]) & (r[1:] == r[:-1])
        out[order[1:]] = same
        if not later:
            out[order[:-1]] |= same
    return out


def base_counts(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of rows."""
    n = len(bounds) - 1
    w = kernels.words(data, bounds)
    code_point = (data & 0xC0) != 0x80
    chars = _sums(code_point & ~kernels.SPACE[data], bounds)
    symbols = _sums(SYMBOLS[data], bounds)

    # lines with a word: the line of each word's start, words being in order
    breaks = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([bounds[:-1], breaks + 1]))
    line = np.unique(np.searchsorted(cuts, w.start, "right") - 1) if len(w.start) else np.zeros(0, np.int64)
    start = cuts[line] if len(line) else np.zeros(0, np.int64)
    row = np.searchsorted(bounds, start, "right") - 1
    next_break = np.append(breaks, len(data))[np.searchsorted(breaks, start)] if len(line) else start
    end = np.minimum(next_break, bounds[row + 1]) if len(line) else start
    dup = np.bincount(row[_repeats(kernels.span_hashes(data, start, end), row, True)], minlength=n)

    hashes, at = kernels.window_hashes(w)
    again = at[_repeats(hashes, w.row[at], False)]
    cover = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + kernels.WORDS_IN_SHINGLE, -1)
    covered = np.cumsum(cover[:-1]) > 0
    repeat = _sums(covered, w.row_at)
    return [np.diff(w.row_at), chars, symbols, dup, repeat]


def band_verdict(raw: bytes, compressor, bands: Bands) -> tuple[float, float, bool]:
    """(whole ratio, share of bytes in chunks outside their band, inside the
    bands). A text shorter than a chunk is judged as a whole only."""
    if not raw:
        return 0.0, 0.0, True

    def judged(part: bytes) -> tuple[float, bool]:
        ratio = len(compressor.compress(part)) / len(part)
        _, low, high = [b for b in bands.whole if len(part) >= b[0]][-1]
        return ratio, low <= ratio <= high

    whole, inside = judged(raw)
    bad = 0
    tail = len(raw) - len(raw) % bands.chunk_bytes
    for k in range(0, tail, bands.chunk_bytes):
        chunk = raw[k : k + bands.chunk_bytes]
        if not bands.chunk_low <= len(compressor.compress(chunk)) / len(chunk) <= bands.chunk_high:
            bad += len(chunk)
    if 0 < tail < len(raw) and not judged(raw[tail:])[1]:
        bad += len(raw) - tail
    return whole, bad / len(raw), inside and bad / len(raw) <= bands.bad_share


def _score(bands: Bands):
    def run(batches):
        import zstandard

        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            verdicts: list[tuple[float, float, bool]] = []
            for _, n, data, bounds in kernels.steps(batch.column(batch.num_columns - 1)):
                parts.append(base_counts(data, bounds))
                raw = data.tobytes()
                verdicts += [band_verdict(raw[bounds[k] : bounds[k + 1]], compressor, bands) for k in range(n)]
            counts = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 5
            failed = (counts[0] < 10) | (100 * counts[4] > 20 * counts[0])
            inside = np.array([v[2] for v in verdicts], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([v[0] for v in verdicts], pa.float64()),
                    pa.array([v[1] for v in verdicts], pa.float64()),
                    pa.array(failed),
                    pa.array(~failed & inside),
                ],
                names=[*batch.schema.names[:-1], *(c.split()[0] for c in SCHEMA.split(", "))],
            )

    return run


def quality(docs: DataFrame, bands: Bands | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of each whole text, without a shuffle.

    A null text has no words and fails the base rule, as an empty one does. A
    very long one is judged whole and in all its chunks. A ratio on a band's
    edge is inside. Repeated rows and null ids are scored like others; other
    columns are ignored; an empty table stays empty.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(_score(bands or Bands()), f"doc_id long, {SCHEMA}")


def accepted(docs: DataFrame, bands: Bands | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever
    their names; nulls, long texts and repeated rows as in ``quality``."""
    kept = _score(bands or Bands())

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index(text_col)
            text = pa.RecordBatch.from_arrays([batch.column(at).cast(pa.string())], names=["_text"])
            out = next(iter(kept(iter([text]))))
            yield batch.filter(out.column(out.schema.get_field_index("kept")))

    return docs.mapInArrow(run, docs.schema)
