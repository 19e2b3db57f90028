"""Token ids of whole texts, by the tokenizers library.

A byte-level BPE tokenizer cuts a text into pieces by a pattern and encodes
each on its own, so ids of equal pieces are equal. Texts are cut here at places
where that pattern always cuts, and each worker keeps the ids of the chunks it
has met, so that the tokenizer encodes a frequent chunk once. Texts that hold
an added token (``<|endoftext|>``) and tokenizers of another make are encoded
whole, so ids are always those that the library gives for the whole text.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa

#: Characters of text encoded in one step; a longer text forms a step alone.
STEP_CHARS = 1 << 20

#: Bytes that the chunks which a worker keeps may take, besides those of a
#: step; the older half goes when they take more.
MOST_BYTES = 200 << 20

#: What a kept chunk takes besides its text and ids: a string, a number, their
#: place in a dict, and two bounds.
BYTES_PER_CHUNK = 180

#: Chunks joined for one call of the tokenizer.
JOINED = 2000

END_ID = 2

_loaded: dict[str, Tokens] = {}

# Where a text can't be cut before each space and line break: in a run of white
# space that goes on after one of them.
_RUN = re.compile(r"\s[ \n](?:\s|$)|\0")
# Where it can't be cut before stops and commas: after anything but a letter or
# digit, with which they could form one piece.
_JOINED_STOP = re.compile("[^A-Za-z0-9À-ÖØ-öø-ɏ][.,]")

# What is one piece for sure, or one after a line break, which is one itself,
# and needs no cutting by the pattern.
_PIECE = re.compile("\n?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+)| (?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+)|[.,]")

# Bytes that a first look at a text goes by.
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[44, 46]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
# Leading bytes of other white space, and of what has no plain letters.
_RARE = np.zeros(256, bool)
_RARE[[0, 0xC2, 0xE1, 0xE2, 0xE3]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """How byte-level BPE writes bytes: printable ones as themselves, the rest
    in order as the code points from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def doubtful(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text whether it may have a run that can't be cut, and whether
    it may have a stop or comma that can't; both are certain if false."""
    if not len(data):
        none = np.zeros(len(bounds) - 1, bool)
        return none, none
    white = _WHITE[data]
    run = np.zeros(len(data) + 1, bool)
    run[1:-1] = white[1:] & white[:-1]
    run[:-1] |= _RARE[data]
    stop = np.flatnonzero(_STOP[data])
    before = data[np.maximum(stop - 1, 0)]
    letter = _PLAIN[before] & (stop > 0)
    # two-byte Latin letters; the signs for times and divided by aren't letters
    lead = data[np.maximum(stop - 2, 0)]
    accented = (before >= 0x80) & (lead >= 0xC3) & (lead <= 0xC9) & ~((lead == 0xC3) & ((before == 0x97) | (before == 0xB7)))
    joined = stop[~(letter | accented)]

    def any_in(places: np.ndarray) -> np.ndarray:
        return np.searchsorted(places, bounds[1:]) > np.searchsorted(places, bounds[:-1])

    return any_in(np.flatnonzero(run[:-1])), any_in(joined)


def chunks(text: str, run: bool = True, joined_stop: bool = True) -> list[str] | None:
    """Chunks of a text that byte-level BPE encodes on their own, or None.

    A piece holds white space at its start only, unless it is a run of it. So
    there is a cut before each space or line break that follows something else,
    and before the last of a run. A letter or digit never shares a piece with
    a stop or comma after it. The flags tell whether to look for exceptions.
    """
    if run and _RUN.search(text):
        return None
    marked = text.replace(" ", "\0 ").replace("\n", "\0\n")
    if not (joined_stop and _JOINED_STOP.search(text)):
        marked = marked.replace(".", "\0.").replace(",", "\0,")
    return marked.split("\0")


@contextmanager
def uncollected():
    """Nothing here is cyclic, so searching its many small lists for cycles is
    time lost."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def numbers(known: dict[str, int]) -> defaultdict[str, int]:
    """Chunks with their numbers, in order from 0; a new one gets the next."""
    return defaultdict(count(len(known)).__next__, known)


class Tokens:
    """A tokenizer with the ids of the chunks that it has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        spec = json.loads(self.plain.to_str())
        pre, special = spec["pre_tokenizer"] or {}, [t for t in spec["added_tokens"] if t["special"]]
        self.added = [t["content"] for t in spec["added_tokens"]]
        byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.cutting = bool(byte_level and spec["normalizer"] is None and spec["model"]["type"] == "BPE" and special)
        if self.cutting:
            # a special token parts chunks from each other
            self.part, self.part_id = special[0]["content"], special[0]["id"]
            self.letters = byte_letters()
            self.model = self.plain.model
            self.line_break = [t.id for t in self.model.tokenize(self.letters[10])]
        self._forget()

    def _forget(self) -> None:
        self.known = numbers({})
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.held = 0

    def _shrink(self) -> None:
        """Forget the older half."""
        old = len(self.known) // 2
        first = int(self.start[old])
        self.known = numbers({w: k - old for w, k in islice(self.known.items(), old, None)})
        self.start, self.length = self.start[old:] - first, self.length[old:]
        self.pool = self.pool[first:].copy()
        self.held = sum(map(len, self.known)) + BYTES_PER_CHUNK * len(self.known) + self.pool.nbytes

    def _piece(self, piece: str) -> list[int]:
        """Ids of one piece, or of a line break and one, straight from the model."""
        if piece[0] == "\n":
            return self.line_break + self._piece(piece[1:])
        if piece.isascii():  # a space and letters that stand for themselves
            written = piece.replace(" ", self.letters[32])
        else:
            written = piece.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(written)]

    def _joined(self, parts: list[str]) -> list[list[int]]:
        """Ids of chunks, parted by the special token, which none holds."""
        joined = [self.part.join(parts[k : k + JOINED]) + self.part for k in range(0, len(parts), JOINED)]
        flat = list(chain.from_iterable(e.ids for e in self.plain.encode_batch_fast(joined, add_special_tokens=False)))
        ends = np.flatnonzero(np.array(flat, np.uint32) == self.part_id).tolist()
        return [flat[a:b] for a, b in zip([0, *(e + 1 for e in ends)], ends, strict=False)]

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, one after another, and how many each has."""
        lists: list = [self._piece(w) if _PIECE.fullmatch(w) else None for w in new]
        rest = [k for k, ids in enumerate(lists) if ids is None]
        for k, ids in zip(rest, self._joined([new[k] for k in rest]), strict=True):
            lists[k] = ids
        length = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.uint32, int(length.sum())), length

    def _learn(self, new: list[str]) -> None:
        ids, length = self._encoded(new)
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.pool = np.concatenate([self.pool, ids])
        self.held += sum(map(len, new)) + BYTES_PER_CHUNK * len(new) + ids.nbytes

    def _cut(self, texts: list[str]) -> tuple[list, np.ndarray, np.ndarray]:
        """Chunks of each text or None, ids of all chunks, and their bounds."""
        cut: list[list[str] | None] = [None] * len(texts)
        if self.cutting:
            raw = [t.encode() for t in texts]
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
            flags = doubtful(np.frombuffer(b"".join(raw), np.uint8), bounds)
            cut = [None if any(a in t for a in self.added) else chunks(t, r, j) for t, r, j in zip(texts, flags[0].tolist(), flags[1].tolist(), strict=True)]
        flat = list(chain.from_iterable(c for c in cut if c))
        while self.held > MOST_BYTES and len(self.known) > 1:
            self._shrink()
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        new = list(islice(reversed(self.known), len(self.known) - len(self.length)))
        if new:
            self._learn(new[::-1])
        length = self.length[at]
        ends = np.cumsum(length)
        place = np.arange(int(ends[-1]) if len(ends) else 0)
        ids = self.pool[place + np.repeat(self.start[at] - ends + length, length)]
        return cut, ids, np.concatenate([[0], ends])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        with uncollected():
            cut, ids, bounds = self._cut(texts)
        whole = iter(self.plain.encode_batch_fast([t for t, c in zip(texts, cut, strict=True) if c is None], add_special_tokens=False))
        first = 0
        for c in cut:
            if c is None:
                yield np.array(next(whole).ids, np.uint32)
            else:
                yield ids[bounds[first] : bounds[first + len(c)]]
                first += len(c)


def load(path: str) -> Tokens:
    """The tokenizer in ``path``, once per worker. The file belongs to an
    installed package, so every executor has it under its own path."""
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def encode(texts: pa.Array, path: str, end_id: int = END_ID) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids with the end id) of each text; a null is empty."""
    tokenizer = load(path)
    end = np.array([end_id], np.uint32)
    waiting: list[str] = []
    size, first = 0, 0
    for k in range(len(texts)):
        text = texts[k].as_py() or ""
        waiting.append(text)
        size += len(text)
        if size >= STEP_CHARS or k == len(texts) - 1:
            for j, ids in enumerate(tokenizer.encode(waiting)):
                yield first + j, np.concatenate([ids, end])
            first, waiting, size = k + 1, [], 0
