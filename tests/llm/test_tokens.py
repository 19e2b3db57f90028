"""Ids of chunks against those of whole texts."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloneloom.llm import tokens


def plain(texts, name="byte_bpe_50k.json"):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [[*e.ids, 2] for e in t.encode_batch(texts, add_special_tokens=False)]


def got(texts, name="byte_bpe_50k.json"):
    return [ids.tolist() for _, ids in tokens.encode(pa.array(texts), public_tokenizers.path(name))]


ODD = [
    "", " ", "  ", "\n", "a\n", "a \n", "a  b", "a   b", "a\n\nb", "a\n\n\nb", "a \n b", "\ta b\t c \t", "it's we'll.I'm, ok",
    "x%%%, y.!! z .. ,, 1.2,3 . , a_.b", "<|endoftext|> a <|endoftext|>b", "hello <|endoftext|> world", "<|endoftext|", "<|endoftext|>", "a\0b c", "été. ñandú, ×. ß,", "東京。 です. 😀, ok",
    "a  b  c  d\x85 e \x1c f", "\r\n a\r\n\r\nb", ".start ,x", "a" * 3000 + " " + "b." * 500,
]


def test_odd_texts():
    assert got(ODD) == plain(ODD)


def test_documents(texts):
    values = list(texts.values())
    assert got(values) == plain(values)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t.,'aé9%s_ ̀東<|>", max_size=40), max_size=5))
def test_any_text(values):
    assert got(values) == plain(values)


def test_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_BYTES", 60 * tokens.BYTES_PER_CHUNK)
    monkeypatch.setattr(tokens, "_loaded", {})
    monkeypatch.setattr(tokens, "STEP_CHARS", 50)
    rng = random.Random(1)
    values = [" ".join("w%d" % rng.randrange(300) for _ in range(rng.randrange(40))) for _ in range(200)]
    assert got(values) == plain(values)
    assert len(tokens.load(tokens.default_tokenizer()).known) <= 120


def test_long_chunks_are_forgotten_by_their_bytes(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_BYTES", 20_000)
    monkeypatch.setattr(tokens, "STEP_CHARS", 1000)
    monkeypatch.setattr(tokens, "_loaded", {})
    values = [chr(0x4E00 + k) * 3000 for k in range(40)]
    assert got(values) == plain(values)
    assert tokens.load(tokens.default_tokenizer()).held < 60_000


def test_special_tokens_are_those_of_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "hello <|endoftext|> world"
    assert got([text]) == [[*t.encode(text, add_special_tokens=False).ids, 2]]
    assert 50256 in got([text])[0]


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_get_whole_texts(name):
    assert not tokens.load(public_tokenizers.path(name)).cutting
    assert got(ODD, name) == plain(ODD, name)


def test_digits_and_first_words_need_no_cutting():
    """They went through the pattern, at several times the cost of a piece."""
    known = tokens.Tokens(tokens.default_tokenizer())
    asked: list[str] = []
    cut = known._joined
    known._joined = lambda parts: asked.extend(parts) or cut(parts)
    text = "Ab 12\nC 3\n45, d.\nÉté 6 7\n"
    want = known.plain.encode(text, add_special_tokens=False).ids
    assert next(known.encode([text])).tolist() == want and asked == ["\n"]
