"""Runs of given bytes in texts, and distinct terms that a task gathers: what operators 11 to 13 share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from claraudit.llm.words import Pieces, Remembered, Texts, ragged

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of the bytes in the given ranges, both ends included."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Letters and all that isn't ASCII; the same and digits; everything but white space. Bytes of lower-cased text.
LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
WORDS = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def lower_ascii(t: Texts) -> Texts:
    """A-Z in lower case, all else unchanged."""
    return Texts(_LOWER[t.data], t.bounds)


def runs(t: Texts, inside: np.ndarray) -> Pieces:
    """The maximal runs of the bytes of `inside`; none crosses a row's end."""
    edge = np.zeros(len(t.data) + 1, bool)
    edge[t.bounds] = True
    here = np.zeros(len(t.data) + 2, bool)
    here[1:-1] = inside[t.data]
    starts = np.flatnonzero(here[1:-1] & (~here[:-2] | edge[:-1]))
    ends = np.flatnonzero(here[1:-1] & (~here[2:] | edge[1:])) + 1
    return Pieces(t, starts, ends, np.searchsorted(starts, t.bounds))


def remember(known: Remembered, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(code of each piece, row in `known` of each code); new pieces are added."""
    hashes = p.hashes()
    code, first = p.exact_codes(hashes)
    starts, ends, hashes = p.starts[first], p.ends[first], hashes[first]
    rows = known.find(p.texts.data, starts, ends, hashes)
    new = np.flatnonzero(rows < 0)
    if len(new):
        rows[new] = known.add(p.texts.data, starts[new], ends[new], hashes[new])
    return code, rows


def strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """data[s:s + n] for each start and length as an Arrow column."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = ragged(data, starts, lengths)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(flat)).cast(pa.string())


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, ascending, and the sums of their values."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], *[np.add.reduceat(v[order], at) for v in values]
