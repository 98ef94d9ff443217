"""Whole-text encoding with the tokenizers library, once for each distinct piece instead of once for each occurrence.

Both public vocabularies split a text at white space before any merge, so the ids of a text are the ids of its pieces,
joined. Pieces repeat, so a task encodes the distinct pieces of a batch that it hasn't met yet and gathers ids by numpy.
Pieces are the same only if their bytes are. New pieces go to the library many at a time, with one of its special tokens
between them: it handles what stands between special tokens as texts of their own.
"""

from __future__ import annotations

import os
from functools import partial

import numpy as np

from claraudit.llm.common import held
from claraudit.llm.words import Pieces, Remembered, Texts, ragged, spaced_words, words

#: Bytes of text that are encoded at once, bytes of pieces that a task remembers, pieces in one call of the library.
SLICE_BYTES, REMEMBERED_BYTES, TOGETHER = 2 << 20, 24 << 20, 64


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """splits: 'words' for vocabularies that drop white space, 'spaced' for those that keep it."""

    def __init__(self, path: str, splits: str, remembered: int = REMEMBERED_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.cut = Tokenizer.from_file(path), {"words": partial(words, points=True), "spaced": spaced_words}[splits]
        plain = [(i, x.content) for i, x in self.tokenizer.get_added_tokens_decoder().items() if x.special and not (x.lstrip or x.rstrip or x.single_word or x.normalized)]
        self.mark_id, self.mark = min(plain, default=(None, None))
        self.most = remembered
        self._forget()

    def _forget(self) -> None:
        self.known = Remembered()
        self.flat, self.offsets, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, new: list[str]) -> list[np.ndarray]:
        """The ids of each piece."""
        if self.mark is None or any(self.mark in x for x in new):
            return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        flat = np.array(self.tokenizer.encode_batch_fast([self.mark.join(new)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(flat == self.mark_id)
        starts, ends = np.concatenate([[0], cuts + 1]), np.append(cuts, len(flat))
        return [flat[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        rows, raw, flat, lengths = self.known.add(data, starts, ends, hashes), data.tobytes(), [self.flat], []
        for i in range(0, len(starts), TOGETHER):
            some = zip(starts[i : i + TOGETHER].tolist(), ends[i : i + TOGETHER].tolist(), strict=True)
            got = self._ids([raw[a:b].decode("utf-8", "replace") for a, b in some])
            flat += got
            lengths += map(len, got)
        more = np.array(lengths, np.int64)
        self.offsets = np.concatenate([self.offsets, len(self.flat) + np.cumsum(more) - more])
        self.lengths, self.flat = np.concatenate([self.lengths, more]), np.concatenate(flat)
        return rows

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids joined, and the bounds of each row's ids."""
        pieces: Pieces = self.cut(texts)
        hashes = pieces.hashes()
        codes, first = pieces.exact_codes(hashes)
        if self.known.bytes() + 4 * len(self.flat) > self.most:
            self._forget()
        starts, ends, hashes = pieces.starts[first], pieces.ends[first], hashes[first]
        rows = self.known.find(texts.data, starts, ends, hashes)
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = self._learn(texts.data, starts[new], ends[new], hashes[new])
        known = rows[codes]
        lengths = self.lengths[known]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        return ragged(self.flat, self.offsets[known], lengths), bounds[pieces.first]


def encoder(path: str, splits: str, remembered: int = REMEMBERED_BYTES) -> Encoder:
    """One for each Python worker, for as long as its tasks encode; it remembers words up to so many bytes."""
    return held(("encoder", path, splits, remembered), lambda: Encoder(path, splits, remembered))


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends the id `end` to each row's ids."""
    rows = len(bounds) - 1
    out = np.empty(len(ids) + rows, np.uint32)
    new = bounds + np.arange(rows + 1)
    mask = np.ones(len(out), bool)
    mask[new[1:] - 1] = False
    out[mask], out[new[1:] - 1] = ids, end
    return out, new
