"""Many (hash, owner) pairs as few fat rows: numpy on both sides, Spark shuffles in between."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .words import U

FAT = "part int, pairs binary"


def pack(hashes: np.ndarray, owner: np.ndarray, names: np.ndarray, parts: int) -> pa.RecordBatch:
    """One row per part: its hashes, each with the place of its owner in the row's own list of names.

    ``owner`` are places in ``names`` (64-bit); hashes are dealt out by their remainder.
    """
    part = (hashes % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, hashes, owner = part[order], hashes[order], owner[order]
    at = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(at[1:], len(part))
    rows = []
    for a, b in zip(at.tolist(), ends.tolist(), strict=True):
        own, place = np.unique(owner[a:b], return_inverse=True)
        small = np.uint16 if len(own) <= 1 << 16 else np.uint32
        rows.append(np.array([b - a, len(own)], dtype=np.uint32).tobytes() + names[own].tobytes()
                    + hashes[a:b].tobytes() + place.astype(small).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int32)), pa.array(rows, pa.binary())],
                                      names=["part", "pairs"])


def unpack(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, names of their owners) of all rows."""
    hashes, owners = [np.empty(0, dtype=U)], [np.empty(0, dtype=U)]
    for r in rows:
        n, k = np.frombuffer(r, dtype=np.uint32, count=2).tolist()
        names = np.frombuffer(r, dtype=U, count=k, offset=8)
        hashes.append(np.frombuffer(r, dtype=U, count=n, offset=8 + 8 * k))
        small = np.uint16 if k <= 1 << 16 else np.uint32
        owners.append(names[np.frombuffer(r, dtype=small, count=n, offset=8 + 8 * (k + n))])
    return np.concatenate(hashes), np.concatenate(owners)


def distinct_pairs(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs sorted by hash, and how many owners each pair's hash has."""
    order = np.lexsort((owners, hashes))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    hashes, owners = hashes[new], owners[new]
    at = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] + U(1))) if len(hashes) else np.empty(0, np.int64)
    sizes = np.diff(at, append=len(hashes))
    return hashes, owners, np.repeat(sizes, sizes)
