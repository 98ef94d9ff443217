"""Vectorised splitting and hashing of texts, straight on the UTF-8 bytes of an Arrow column.

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r. All pieces of a batch are handled by a few
numpy passes over their 8-byte chunks, each of which goes through a 64-bit finaliser before the next one is mixed in.
Pieces of up to 7 bytes have hashes of their own; longer ones may share one, so exact_codes() and Remembered compare
bytes wherever hashes are equal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa

from claraudit.llm.common import text_slices

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


#: Pieces beyond this many bytes are hashed one by one.
LONG = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def _padded(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one number."""
    raw = np.zeros(len(data) + 8, np.uint8)
    raw[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", raw, strides=(1,))


def hash_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; no two pieces of up to 7 bytes share one."""
    from hashlib import blake2b

    n = ends - starts
    chunks = _padded(data)
    h = mix(chunks[starts] & _MASK[np.minimum(n, 8)] | np.minimum(n, 8).astype(_U) % _U(8) << _U(56))
    todo = np.flatnonzero((n > 7) & (n <= LONG))
    if len(todo):
        at, left, own = starts[todo], n[todo], h[todo] ^ n[todo].astype(_U) * _U(0xA24BAED4963EE407)
        for j in range(8, LONG, 8):
            live = np.flatnonzero(left > j)
            if not len(live):
                break
            some = chunks[at[live] + j] & _MASK[np.minimum(left[live] - j, 8)]
            own[live] = mix(own[live] * _U(0x9FB21C651E98DF25) + some)
        h[todo] = mix(own)
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return h


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether a[x:x + n] and b[y:y + n] are equal, for each pair of starts and length."""
    same = np.ones(len(n), bool)
    long = n > LONG
    todo = np.flatnonzero(~long)
    if len(todo):
        ca, cb = _padded(a), _padded(b)
        for j in range(0, LONG, 8):
            todo = todo[n[todo] > j]
            if not len(todo):
                break
            differ = (ca[a_starts[todo] + j] ^ cb[b_starts[todo] + j]) & _MASK[np.minimum(n[todo] - j, 8)] != 0
            same[todo[differ]] = False
    for i in np.flatnonzero(long).tolist():
        same[i] = np.array_equal(a[a_starts[i] : a_starts[i] + n[i]], b[b_starts[i] : b_starts[i] + n[i]])
    return same


@dataclass
class Texts:
    """Rows of an Arrow string column as one byte buffer: row i is data[bounds[i]:bounds[i + 1]]; a null is empty."""

    data: np.ndarray
    bounds: np.ndarray

    @staticmethod
    def of(column: pa.Array) -> Texts:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        _, offsets, data = column.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
        flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return Texts(flat[bounds[0] : bounds[-1]], bounds - bounds[0])

    def rows(self, a: int, b: int) -> Texts:
        return Texts(self.data[self.bounds[a] : self.bounds[b]], self.bounds[a : b + 1] - self.bounds[a])

    def parts(self, most: int):
        """(first row, Texts) for slices of at most `most` bytes, a row at least."""
        for a, b in text_slices(np.diff(self.bounds).tolist(), most):
            yield a, self.rows(a, b)

    def __len__(self) -> int:
        return len(self.bounds) - 1


@dataclass
class Pieces:
    """Byte ranges [starts, ends) of a Texts; row i has pieces first[i] to first[i + 1] - 1."""

    texts: Texts
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), self.counts())

    def hashes(self) -> np.ndarray:
        return hash_pieces(self.texts.data, self.starts, self.ends)

    def exact_codes(self, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(code of each piece, index of each code's first piece): equal codes where bytes are equal."""
        return exact_codes(self.texts.data, self.starts, self.ends, self.hashes() if hashes is None else hashes)


def exact_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes by hash, then by bytes where pieces of one hash differ."""
    codes, distinct = pd.factorize(hashes)
    first = np.zeros(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    n = ends - starts
    long = np.flatnonzero((n > 7) | (n[first[codes]] > 7))
    mine = first[codes[long]]
    other = long[(n[long] != n[mine]) | ~same_bytes(data, starts[long], data, starts[mine], np.minimum(n[long], n[mine]))]
    more: dict[tuple[int, bytes], int] = {}
    added = []
    for i in other.tolist():
        key = (int(codes[i]), data[starts[i] : ends[i]].tobytes())
        if key not in more:
            more[key] = len(first) + len(added)
            added.append(i)
        codes[i] = more[key]
    return codes, np.concatenate([first, np.array(added, np.int64)])


class Remembered:
    """An exact map from pieces to rows 0, 1, ... in the order of adding, held in a few arrays."""

    def __init__(self):
        self.hashes, self.rows = np.zeros(0, _U), np.zeros(0, np.int64)  # sorted by hash
        self.data, self.starts, self.lengths = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def bytes(self) -> int:
        return len(self.data) + 32 * len(self.starts)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The row of each piece, -1 for those not held."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self):
            return out
        at, todo = np.searchsorted(self.hashes, hashes), np.arange(len(starts))
        while len(todo):
            todo = todo[at[todo] < len(self.hashes)]
            todo = todo[self.hashes[at[todo]] == hashes[todo]]
            row, n = self.rows[at[todo]], ends[todo] - starts[todo]
            good = self.lengths[row] == n
            good[good] = same_bytes(data, starts[todo[good]], self.data, self.starts[row[good]], n[good])
            out[todo[good]] = row[good]
            todo = todo[~good]
            at[todo] += 1
        return out

    def add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Takes in distinct pieces that it doesn't hold; their rows."""
        rows, lengths = np.arange(len(self), len(self) + len(starts)), ends - starts
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.rows = np.insert(self.hashes, at, hashes[order]), np.insert(self.rows, at, rows[order])
        self.starts = np.concatenate([self.starts, len(self.data) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.data = np.concatenate([self.data, ragged(data, starts, lengths)])
        return rows


def _edges(t: Texts) -> np.ndarray:
    edge = np.zeros(len(t.data) + 1, bool)
    edge[t.bounds] = True
    return edge


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_POINT = np.zeros(256, bool)
_POINT[[ord(x) for x in ",.;:!?"]] = True


def _points(t: Texts) -> np.ndarray:
    """Where a Latin letter meets a point of _POINT: each public pre-tokeniser ends a piece there."""
    d = t.data
    at = np.flatnonzero(_POINT[d])
    at = at[at > 0]
    p = d[at - 1]
    latin = (p >= 0x80) & (p <= 0xBF) & (p != 0x97) & (p != 0xB7) & (d[np.maximum(at - 2, 0)] == 0xC3) & (at > 1)
    return at[_LETTER[p] | latin]


def words(t: Texts, points: bool = False) -> Pieces:
    """points: cut before a point behind a letter too."""
    space, edge = _SPACE[t.data], _edges(t)
    before = np.ones(len(space) + 1, bool)
    before[1:] = space
    starts = np.flatnonzero(~space & (before[:-1] | edge[:-1]))
    after = np.ones(len(space) + 1, bool)
    after[:-1] = space
    ends = np.flatnonzero(~space & (after[1:] | edge[1:])) + 1
    if points and len(more := (at := _points(t))[~edge[at]]):
        starts, ends = np.sort(np.concatenate([starts, more])), np.sort(np.concatenate([ends, more]))
    return Pieces(t, starts, ends, np.searchsorted(starts, t.bounds))


def spaced_words(t: Texts) -> Pieces:
    """Every byte is in a piece: a run of spaces and the word after it. No cut stands behind a non-ASCII space, where
    byte-level pre-tokenisers may join both sides."""
    data, space = t.data, _SPACE[t.data]
    edge = _edges(t)[:-1]
    before = np.zeros(len(space), bool)
    before[1:] = space[:-1]
    cut = np.flatnonzero(edge | (space & ~before))
    odd = cut[(cut > 0) & (data[np.maximum(cut - 1, 0)] >= 0x80) & ~edge[cut]]
    if len(odd):
        tails = [bytes(data[max(0, i - 3) : i]) for i in odd]
        wide = np.array([x.decode("utf-8", "ignore")[-1:].isspace() for x in tails], bool)
        cut = np.setdiff1d(cut, odd[wide], assume_unique=True)
    at = _points(t)
    cut = np.sort(np.concatenate([cut, at[~edge[at]]]))
    return Pieces(t, cut, np.append(cut[1:], len(data)) if len(cut) else cut, np.searchsorted(cut, t.bounds))


def windows(hashes: np.ndarray, first: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive pieces of one row and the index of each one's first piece."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    total = np.full(n - k + 1, seed, _U)
    for j in range(k):
        total *= _U(0x9FB21C651E98DF25)
        total += hashes[j : n - k + 1 + j]
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # pieces from here to the row's end
    at = np.flatnonzero(left[: n - k + 1] >= k)
    return mix(total[at]), at


def ragged(flat: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[o:o + n] for each offset and length, joined."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(offsets - (ends - lengths), lengths) + np.arange(total)]
