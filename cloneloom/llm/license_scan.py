"""License scans: MinHash bands over overlapping windows, verified exactly.

A template of ``n`` shingles is sought with windows of the least power of two
that holds them, each window starting a quarter of it after the one before. So
some window overlaps a present template in three quarters of its shingles, and
``bands_for`` gives the bands with which such a window retrieves the template
with the wanted probability. The retrieved template is then verified: the part
of its shingles found around the window must reach the containment.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels

CONTAINMENT = 0.8

#: Chance that the best window retrieves a template that is there.
RETRIEVED = 0.999

#: MinHash values in a band.
ROWS = 1

# Notices by which common licenses are declared.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)

MATCHES = "doc_id long, license string, template int, containment double, first_word long, last_word long"

#: Words are runs of letters and digits; bytes beyond ASCII count as letters.
_SPLIT = np.ones(256, bool)
_SPLIT[128:] = False
_SPLIT[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64


def bands_for(containment: float = CONTAINMENT, retrieved: float = RETRIEVED, rows: int = ROWS) -> int:
    """Bands with which a window retrieves a template with that containment.

    The least similarity: the template has just over half a window's shingles
    (or a whole one's, of which a window holds three quarters) and the text
    has ``containment`` of those that the window overlaps.
    """
    least = min(0.5 * containment / (1 + 0.5 * (1 - containment)), 0.75 * containment / (2 - 0.75 * containment))
    return math.ceil(math.log(1 - retrieved) / math.log(1 - least**rows))


def _shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[kernels.Words, np.ndarray, np.ndarray]:
    w = kernels.words(_LOWER[data], bounds, space=_SPLIT)
    hashes, at = kernels.window_hashes(w)
    return w, hashes, at


def _own_shingles(w: kernels.Words, hashes: np.ndarray, at: np.ndarray, row: int) -> tuple[np.ndarray, int]:
    """A row's shingles in order, and its first word. Fewer than five words
    have no shingle: no template is that short."""
    a, b = np.searchsorted(at, w.row_at[row : row + 2])
    return hashes[a:b], int(w.row_at[row])


class Catalog:
    """Templates by window size, with the bands of each."""

    def __init__(self, notices, bands: int, rows: int, containment: float):
        self.bands, self.rows, self.containment = bands, rows, containment
        keys = kernels.splitmix(np.arange(1, bands * rows + 1, dtype=_U))
        self.seeds = keys[:, None]
        self.templates: list[tuple[str, np.ndarray]] = []
        self.by_size: dict[int, dict[int, list[int]]] = {}
        for number, (name, text) in enumerate(notices):
            data = np.frombuffer(text.encode(), np.uint8)
            hashes = _own_shingles(*_shingles(data, np.array([0, len(data)])), 0)[0]
            if not len(hashes):
                raise ValueError(f"template {number} ({name}) has fewer than {kernels.WORDS_IN_SHINGLE} words")
            own = np.unique(hashes)
            self.templates.append((name, own))
            size = 1 << (len(own) - 1).bit_length()
            index = self.by_size.setdefault(size, {})
            for key in self.keys(self.minima(own)[:, None])[:, 0].tolist():
                index.setdefault(key, []).append(number)

    def hashed(self, shingles: np.ndarray) -> np.ndarray:
        return kernels.splitmix(shingles[None, :] ^ self.seeds)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        return self.hashed(shingles).min(1)

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """(bands, windows): one number for each band."""
        parts = minima.reshape(self.bands, self.rows, -1)
        total = np.zeros((self.bands, parts.shape[2]), _U)
        for k in range(self.rows):
            total = kernels.splitmix(total ^ parts[:, k])
        return total ^ kernels.splitmix(np.arange(self.bands, dtype=_U))[:, None]

    def retrieved(self, shingles: np.ndarray) -> set[tuple[int, int, int]]:
        """(template, first shingle, shingles) of windows that share a band."""
        out: set[tuple[int, int, int]] = set()
        hashed = self.hashed(shingles)
        n = len(shingles)
        for size, index in self.by_size.items():
            step = max(1, size // 4)
            cuts = np.arange(0, n, step)
            blocks = np.minimum.reduceat(hashed, cuts, axis=1)
            width = min(size // step, blocks.shape[1])
            low = blocks[:, : blocks.shape[1] - width + 1]
            for k in range(1, width):
                low = np.minimum(low, blocks[:, k : blocks.shape[1] - width + 1 + k])
            keys = self.keys(low)
            wanted = np.fromiter(index, _U, len(index))
            for band, window in zip(*np.nonzero(np.isin(keys, wanted)), strict=True):
                for number in index[int(keys[band, window])]:
                    out.add((number, int(window) * step, size))
        return out

    def matches(self, shingles: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(template, containment, first and last shingle) of verified ones,
        the best place of each template."""
        best: dict[int, tuple[float, int, int]] = {}
        for number, at, size in self.retrieved(shingles):
            own = self.templates[number][1]
            low, high = max(0, at - size), min(len(shingles), at + 2 * size)
            held = np.flatnonzero(np.isin(shingles[low:high], own))
            if not len(held):
                continue
            part = len(np.unique(shingles[low:high][held])) / len(own)
            found = (part, low + int(held[0]), low + int(held[-1]))
            if part >= self.containment and (number not in best or (-found[0], found[1]) < (-best[number][0], best[number][1])):
                best[number] = found
        return [(number, *found) for number, found in sorted(best.items())]


def _scan(notices, containment: float):
    def run(batches):
        catalog = Catalog(notices, bands_for(containment), ROWS, containment)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for first, n, data, bounds in kernels.steps(batch.column(1)):
                w, hashes, at = _shingles(data, bounds)
                for k in range(n):
                    own, _ = _own_shingles(w, hashes, at, k)
                    if not len(own):
                        continue
                    for number, part, low, high in catalog.matches(own):
                        row = (batch.column(0)[first + k].as_py(), catalog.templates[number][0], number, part, low, high + kernels.WORDS_IN_SHINGLE - 1)
                        for c, v in zip(out, row, strict=True):
                            c.append(v)
            types = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[c.split()[0] for c in MATCHES.split(", ")])

    return run


def scan(docs: DataFrame, notices=NOTICES, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and template that its text contains: doc_id,
    license, template, containment, first_word, last_word.

    ``template`` numbers ``notices``; words are counted from 0. Case and
    punctuation don't matter. The place is the best one, of equally good ones
    the first; a text that holds a template twice has one row of it. Null,
    empty and short texts have no row; very long ones are searched whole;
    repeated rows have their rows each; null ids are kept. Other columns are
    ignored; an empty table gives no rows. The catalog goes to executors with
    the code, and documents aren't shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan(tuple(notices), containment), MATCHES)
