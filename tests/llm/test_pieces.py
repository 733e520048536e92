"""Pieces of byte-level vocabularies: cut without a pattern where that is right, each word of letters by the model alone."""

from __future__ import annotations

import random
from array import array

from snapplan.llm import tokenize

NAME = "byte_bpe_50k.json"


def of_library(text):
    return array("I", tokenize.tokenizer(NAME).encode(text, add_special_tokens=False).ids).tobytes()


def test_marks_and_newlines_are_encoded_once(monkeypatch):
    """Latin words with a newline before or marks after them need no splitting by the library of their own."""
    calls, split = [], tokenize.piece_ids
    monkeypatch.setattr(tokenize, "_IDS", {})
    monkeypatch.setattr(tokenize, "_TAILS", {})
    monkeypatch.setattr(tokenize, "piece_ids", lambda piece, name: calls.append(piece) or split(piece, name))
    text = "\n".join(f"Zeile{a} wörter{a}%%% more{a}&&, ende{a}." for a in "abcdefghij")
    assert tokenize.byte_level_ids(text, NAME) == of_library(text)
    assert sorted(calls) == ["\n", "%%%", "&&,", "."]


def test_an_even_text_needs_no_pattern(monkeypatch):
    class Never:
        def findall(self, text):
            raise AssertionError(text)

    text = "One line, of 3.14 words\nand it's a second; with (marks)\nA third"
    want = tokenize.PIECE.findall(text)
    monkeypatch.setattr(tokenize, "PIECE", Never())
    assert tokenize.pieces(text) == want


def test_pieces_are_those_of_the_pattern():
    r = random.Random(11)
    some = ["a", "É", "Word", "don't", "'s", " ", " ", "\n", ".", ",", "%", "_", "3", "14", "\t", "\r", "\xa0", "\0", " ",
            "…", "中", "<|endoftext|>", "ª", "́", "&&&", "-", "`"]
    for i in range(4000):
        text = "".join(r.choices(some if i % 2 else some[:12], k=r.choice((3, 12, 900))))
        assert [p for p in tokenize.pieces(text) if p] == tokenize.PIECE.findall(text)
        assert tokenize.byte_level_ids(text, NAME) == of_library(text)
    assert not tokenize.even("a  b") and not tokenize.even("a \nb") and not tokenize.even("a ") and not tokenize.even("a, b.,")
    assert not tokenize.even("a\tb") and not tokenize.even("a\x00b") and tokenize.even(" a, b\nc.") and tokenize.even("")
