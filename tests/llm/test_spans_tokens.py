"""Words, hashes and token ids against plain Python and the tokenizers library."""

import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brindle.llm import spans
from brindle.llm.common import vocabulary
from brindle.llm.spans import span_hashes, span_keys, texts_of, window_hashes, word_hashes, word_spans
from brindle.llm.tokens import UnitEncoder, piece_encoder, unit_encoder
from tests.llm.cases import awkward, words

ODD = st.text(st.sampled_from("aZ é9.,'\n\t  s²日\x85  　-!_\x00"), max_size=40)


@given(st.lists(ODD, max_size=12))
@settings(max_examples=150, deadline=None)
def test_words(texts):
    data, at = texts_of(pa.array(texts, pa.string()))
    starts, ends, owner = word_spans(data, at)
    got = [[] for _ in texts]
    for s, e, o in zip(starts, ends, owner, strict=True):
        got[o].append(data[s:e].tobytes().decode())
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", x) for x in texts]
    flat = [w for ws in got for w in ws]
    hashes = word_hashes(data, starts, ends, fold=True)
    fold = lambda w: re.sub("[A-Z]", lambda m: m[0].lower(), w)
    assert len(set(hashes.tolist())) == len(set(map(fold, flat)))


def test_null_and_sliced_columns():
    column = pa.array(["ab", None, "", "cd ef"])
    data, at = texts_of(column)
    assert data.tobytes() == b"abcd ef" and at.tolist() == [0, 2, 2, 2, 7]
    data, at = texts_of(column.slice(1, 3))
    assert data.tobytes() == b"cd ef" and at.tolist() == [0, 0, 0, 5]
    data, at = texts_of(pa.array([], pa.string()))
    assert len(data) == 0 and at.tolist() == [0]


def test_windows_depend_on_order():
    h = window_hashes(np.array([1, 2, 3, 1, 2, 3, 2, 1], np.uint64), 3)
    assert h[0] == h[3] and len(set(h.tolist())) == 5
    assert len(window_hashes(np.array([1], np.uint64), 3)) == 0


def thue_morse(rounds):
    """A word over a and b, and its complement: they collide in any polynomial modulo 2**64 once long enough."""
    word = "a"
    for _ in range(rounds):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_regular_words_do_not_collide():
    words = [*thue_morse(10), *thue_morse(12), "a" * 1024, "ab" * 512, "ba" * 512]
    data, at = texts_of(pa.array([" ".join(words)]))
    starts, ends, _ = word_spans(data, at)
    for hashes in (span_hashes(data, starts, ends), word_hashes(data, starts, ends), word_hashes(data, starts, ends, fold=True)):
        assert len(set(hashes.tolist())) == len(words)


def test_hashes_do_not_depend_on_chunks(monkeypatch):
    data, at = texts_of(pa.array([" ".join("w" * (i % 9 + 1) + str(i) for i in range(500))]))
    starts, ends, _ = word_spans(data, at)
    whole = span_hashes(data, starts, ends)
    monkeypatch.setattr(spans, "_CHUNK", 64)
    assert (span_hashes(data, starts, ends) == whole).all()
    assert (span_hashes(data[starts[9] :], starts[9:] - starts[9], ends[9:] - starts[9]) == whole[9:]).all()


@pytest.fixture(scope="module")
def encoder():
    return unit_encoder(vocabulary())


@pytest.fixture(scope="module")
def library():
    """The tokenizer as the file gives it."""
    return Tokenizer.from_file(vocabulary())


def same_as(library, encoder, texts):
    ids, at = encoder.encode(*texts_of(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [library.encode(x, add_special_tokens=False).ids for x in texts]


MARKED = st.lists(st.sampled_from(["<|endoftext|>", "<|endo", "ftext|>", "a", " b", "\n", "|>"]), max_size=6).map("".join)


@given(st.lists(ODD | MARKED, min_size=1, max_size=8))
@settings(max_examples=300, deadline=None)
def test_ids_are_the_library_s(encoder, library, texts):
    same_as(library, encoder, texts)


def test_ids_of_awkward_texts(encoder, library):
    long, other = thue_morse(10)
    texts = [r[1] or "" for r in awkward()] + ["a <|endoftext|> b", "don't we'll I'M", "x" * 5000, "12.34,56", "a.b. c.\nD", long, other, f"{other} {long}"]
    same_as(library, encoder, texts)
    same_as(library, encoder, texts[::-1])


def test_texts_of_many_words(encoder, library):
    same_as(library, encoder, [words(5, 30_000), "é " * 40_000, "12 " * 25_000, "<|endoftext|>" + words(6, 25_000)])


def test_keys_of_short_spans_are_the_spans():
    texts = ["a", "a\0", "\0", "\0\0", "abcdefg", "abcdef", "abcdef\0", "abcdefgh", "é", "b", "c" * 300, "c" * 301]
    data, at = texts_of(pa.array(texts))
    keys = span_keys(data, at[:-1], np.diff(at))
    assert len(set(keys.tolist())) == len(texts)
    again, at = texts_of(pa.array(texts[::-1]))
    assert span_keys(again, at[:-1], np.diff(at)).tolist() == keys.tolist()[::-1]


@pytest.mark.parametrize("limit, text", [(20, 1 << 24), (60, 1 << 24), (10**6, 30), (10**6, 200)])
def test_what_is_met_again_stays(library, monkeypatch, limit, text):
    monkeypatch.setattr(UnitEncoder, "TEXT_MOST", text)
    small = UnitEncoder(vocabulary(), limit=limit)
    for k in range(12):
        same_as(library, small, [f"the same words in every considerable batch {words(k, 9, 10**9)}", words(k % 3, 9, 10**9), "é, unbelievable 漢字"])


def test_forgetting_changes_nothing(library, monkeypatch):
    small = UnitEncoder(vocabulary(), limit=3)
    for x in ("one two three four five", "six seven eight", "one two three", "nine ten"):
        same_as(library, small, [x])
    monkeypatch.setattr(UnitEncoder, "TEXT_MOST", 4)
    for x in ("one two three four five", "six seven eight", "one two three", "nine ten"):
        same_as(library, small, [x, x])


def test_equal_hashes_are_told_apart(library, monkeypatch):
    monkeypatch.setattr(spans, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    small = UnitEncoder(vocabulary())
    texts = ["one two three four", "five six, seven", "", "one two two three.", "ninety-nine", "extraordinary international", "an internationally extraordinarily", "\0\0a a\0 a", "é" * 9]
    same_as(library, small, texts)
    same_as(library, small, texts[::-1])


def test_words_as_pieces():
    p = piece_encoder(vocabulary("piece_bpe_32k.model"))
    text = "The Übergang of naïve words , and 漢字 too ."
    data, at = texts_of(pa.array([text]))
    ids, _ = p.ids(data, *word_spans(data, at)[:2])
    assert ids.tolist() == p.pieces.encode(text)
