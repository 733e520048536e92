"""Vectorised word hashes of many texts at once (numpy, no loop over words).

Texts are joined as UTF-8; a word is a maximal run of word bytes.  Its hash is
a polynomial over byte values, taken from prefix sums modulo 2**64 and mixed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .worker import turn_to

U = np.uint64
#: odd multipliers and seeds of the hashes (any fixed odd values do)
BASE, STEP, STEP2 = U(0x9E3779B97F4A7C15 | 1), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
SPACE = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _byte_values(lower: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=U) * BASE) | U(1)
    if lower:
        v[65:91] = v[97:123]
    return v


VALUES = {low: _byte_values(low) for low in (False, True)}

#: word bytes: all but white space; letters, digits and all non-ASCII bytes
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(SPACE)] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

#: powers of each base that a worker keeps
KEPT = 1 << 21
_POWERS: dict[str, np.ndarray] = {}
_INVERSE = U(pow(int(BASE), -1, 1 << 64))


def _table(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=U)
    p[0] = 1
    return np.multiply.accumulate(p, out=p)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i for i < n, modulo 2**64; a worker keeps tables of at most ``KEPT`` of each."""
    if n > KEPT:
        return _table(BASE, n), _table(_INVERSE, n)
    turn_to(_POWERS)
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(0, n - 1).bit_length()
        _POWERS.update(up=_table(BASE, size), down=_table(_INVERSE, size))
    return _POWERS["up"][:n], _POWERS["down"][:n]


@dataclass
class Words:
    """Words of several texts in order: hashes, byte places in ``data``, and where each text's words begin."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray        # len(texts) + 1 places in ``hashes``
    data: bytes
    sums: np.ndarray         # prefix sums of the polynomial over ``data``

    def prefixes(self, n: int, at: np.ndarray) -> np.ndarray:
        """Hash of the first ``n`` bytes of the words ``at``; a word that is not longer keeps its own hash."""
        begin = self.begin[at]
        longer = self.end[at] - begin > n
        stop = np.minimum(begin + n, len(self.data))
        part = mix((self.sums[stop] - self.sums[begin]) * powers(len(self.data) + 1)[1][begin]) ^ U(n)
        return np.where(longer, part, self.hashes[at])

    def strings(self, lo: int, hi: int) -> list[bytes]:
        d = self.data
        return [d[a:b] for a, b in zip(self.begin[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True)]


def words(texts: list[str | None], word: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    """Hash every word of every text; null counts as empty."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(raw) + b"\n"                    # a line end is never a word byte
    buf = np.frombuffer(data, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(word[buf].astype(np.int8), prepend=0))
    begin, end = edge[0::2], edge[1::2]
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=U)
    np.cumsum(VALUES[lower][buf] * up[:-1], out=total[1:])
    hashes = mix((total[end] - total[begin]) * down[begin])
    sizes = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    first = np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)]))
    return Words(hashes, begin, end, first, data, total)


def windows(hashes: np.ndarray, n: int, step: np.uint64 = STEP) -> np.ndarray:
    """Hash of every ``n`` consecutive words; callers drop those that cross a text's end."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, dtype=U)
    out = np.zeros(m, dtype=U)
    for k in range(n):
        out = out * step + hashes[k:k + m]
    return mix(out)


def batches_of(texts: list[str | None], most: int = 1 << 20):
    """(from, to) ranges of texts of about ``most`` code points together; a longer text is alone."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > lo and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)
