"""Operator 8: exact token counts of whole texts, long ones by overlapping chunks.

A text longer than ``chunk`` code points is encoded in chunks that overlap.
Two neighbouring encodings are spliced at a position that starts a token in
both and that is stable: for a vocabulary of words, a non-space character
after a space.  No word, normalisation or special string reaches over such a
place, so the tokens before it come from the first chunk as if it went on,
and those after it from the second as if it had begun earlier.  If the
overlap has no such place it is widened until one is found or the text ends.

Texts within one chunk need no splice: with a vocabulary of words each of
their words is encoded by itself, and a word seen before not again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import python_ready
from .tokenize import tokenizer, word_ids

#: places where an encoding never depends on the other side, by kind of vocabulary
STABLE = {
    "words": re.compile(r"(?<=[ \n])(?=[^\s])"),
    "byte_level": re.compile(r"(?<=\S)(?=[ \n]\S)"),
}
CHUNK, OVERLAP = 16_384, 256

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def starts(text: str, vocabulary: str) -> list[int]:
    """Where each token of a text starts, in code points."""
    return [a for a, _ in tokenizer(vocabulary).encode(text, add_special_tokens=False).offsets]


def common_boundary(text: str, at: int, left: list[int], right: list[int], stable: re.Pattern) -> int | None:
    """The first stable place from ``at`` on that starts a token in both encodings.

    ``left`` and ``right`` are token starts as places in ``text``.
    """
    both = {x for x in left if x > at} & {x for x in right if x > at}
    return next((x for x in sorted(both) if stable.match(text, x)), None)


def count_tokens(text: str, vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP,
                 kind: str = "words") -> int:
    """Tokens of one text, encoded at most ``chunk`` code points at a time where it has stable places."""
    if len(text) <= chunk:
        return len(tokenizer(vocabulary).encode(text, add_special_tokens=False))
    stable = STABLE[kind]
    total, begin, end = 0, 0, chunk
    left = starts(text[:end], vocabulary)
    while end < len(text):
        wide = overlap
        while True:
            after = max(begin, end - wide)
            upto = min(len(text), after + chunk + wide)
            right = [after + x for x in starts(text[after:upto], vocabulary)]
            # right's first word may be a torn one: only places after it are common
            cut = common_boundary(text, after, left, right, stable)
            if cut is not None or after == begin:
                break
            wide *= 2
        if cut is None:                     # no stable place at all: encode both chunks as one
            end = min(len(text), end + max(chunk, end - begin))
            left = [begin + x for x in starts(text[begin:end], vocabulary)]
            continue
        total += sum(x < cut for x in left)
        left = [x for x in right if x >= cut]
        begin, end = cut, upto
    return total + len(left)


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048,
                 chunk: int = CHUNK, overlap: int = OVERLAP, kind: str = "words") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) of every row.

    Null text counts as empty: no bytes, no tokens.  Null doc_id and repeated
    rows are kept as they come.  Other columns are ignored.  Empty table: no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = dict.fromkeys(texts)
            for t in counts:
                if kind == "words" and len(t) <= chunk:
                    counts[t] = len(word_ids(t, vocabulary)) // 4
                else:
                    counts[t] = count_tokens(t, vocabulary, chunk, overlap, kind)
            n_tokens = pa.array([counts[t] for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), n_tokens,
                 pc.greater(n_tokens, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    python_ready(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, COUNTS)
