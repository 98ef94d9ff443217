"""Interpolated modified Kneser-Ney n-gram model of words, counted in Spark, kept as sorted hash arrays (operator 12).

Tokens are white-space words with A-Z in lower case, and one end of the document; each document begins behind a start that
is context only. The highest order counts occurrences, lower ones distinct tokens in front (occurrences for n-grams at the
start). Each order has three discounts from its counts of counts; what they free goes to the next lower order, and the
lowest order's to V + 1 equal shares, one of which is that of all unknown words.

The model is counted over all training documents and grows with them. Its files, written by tasks to the shared folder:

* words: one file a shard, in the order of hashes: hash, count, bytes. A word's id is its place. Words are told apart by
  their bytes.
* n-grams of each order: one file a shard, sorted by the hash of the ids: adjusted count; and contexts with their sums and
  the numbers of tokens seen once, twice and more often. An n-gram lies in the shard of its context, so one task sees a
  context's n-grams together; those of contexts with more than `heavy` occurrences lie in the shard of the n-gram itself,
  and the sums of such contexts are added up by Spark.

Tasks gather distinct n-grams in bounded arrays and hand them on as compressed blocks of ids, a block for each shard. With
more shards than `COARSE` blocks travel in two steps, so they stay large. A shard has about SHARD_TOKENS occurrences.
Workers map the files into memory and look n-grams up in the order of hashes, so pages are touched one after another and
nothing of the model is held but the sizes of the word shards. Files appear whole, by renaming, and have the same content
whichever attempt writes them, so lost executors do no harm.

The shared folder must be one that workers can map: a mounted file system.

Defined results: a null text is empty, its only token is the end; no training document gives every token probability 1; a
null doc_id counts as an empty text for the held-out part; repeated rows are documents of their own; counts of counts that
don't give discounts (tiny corpora) are replaced by 0.5, 1 and 1.5; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claraudit.llm.common import forget, freed_shuffles, held, release, stage_path, staged
from claraudit.llm.terms import lower_ascii, remember, strings, summed
from claraudit.llm.words import Remembered, Texts, mix, ragged, same_bytes, words

ORDER, HELD_PARTS = 2, 10
#: Words and occurrences of n-grams in a shard, about; n-grams and bytes of words that a task gathers; blocks a task deals.
SHARD_WORDS, SHARD_TOKENS, HELD_GRAMS, WORD_BYTES, COARSE = 1 << 18, 1 << 20, 1 << 20, 48 << 20, 1 << 12
SLICE, MAPPED = 3 << 20, 2048
START, END, UNKNOWN = 0, 1, -1
_U = np.uint64
_FACTOR = _U(0x9FB21C651E98DF25)


def held_out(doc_id: str = "doc_id", parts: int = HELD_PARTS) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == 0


# --- files of arrays -------------------------------------------------------------------------------------------------


def local_root(path: str) -> str:
    """The path of a folder that workers can map."""
    at = urlparse(path)
    if at.scheme not in ("", "file"):
        raise ValueError(f"{path}: workers map the model's files; set spark.checkpoint.dir to a mounted folder")
    return unquote(at.path)


def write_arrays(path: str, **arrays: np.ndarray) -> None:
    """A file with a line that says where each array lies."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    places, at = {}, 0
    for name, x in arrays.items():
        places[name] = [x.dtype.str, len(x), at]
        at += -(-x.nbytes // 8) * 8
    head = json.dumps(places).encode()
    head += b" " * (-(len(head) + 9) % 8)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(len(head).to_bytes(8, "little") + head + b"\n")
        for x in arrays.values():
            f.write(x.tobytes() + bytes(-x.nbytes % 8))
    os.replace(part, path)


def map_arrays(path: str) -> dict[str, np.ndarray] | None:
    """The arrays of a file as parts of a memory map; None where there is no such shard."""
    try:
        raw = np.memmap(path, np.uint8, "r")
    except FileNotFoundError:
        return None
    n = int.from_bytes(raw[:8].tobytes(), "little")
    return {name: raw[9 + n + at : 9 + n + at + size * np.dtype(kind).itemsize].view(kind) for name, (kind, size, at) in json.loads(raw[8 : 8 + n].tobytes()).items()}


def mapped(path: str) -> dict[str, np.ndarray] | None:
    """map_arrays(), once for each worker as long as it uses one model."""
    maps = held(("maps",), dict)
    if path not in maps:
        if len(maps) >= MAPPED:
            maps.clear()
        maps[path] = map_arrays(path)
    return maps[path]


def small(x: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as hold them."""
    top = int(x.max()) if len(x) else 0
    return x.astype("<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


def shard_bits(total: int, each: int) -> int:
    return max(1, (max(1, -(-total // each)) - 1).bit_length())


def shard_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> _U(64 - bits)).astype(np.int64)


def _sections(sorted_shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, start, end) of each run."""
    if len(sorted_shards):
        at = np.flatnonzero(np.concatenate([[True], sorted_shards[1:] != sorted_shards[:-1], [True]]))
        yield from zip(sorted_shards[at[:-1]].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)


# --- words -----------------------------------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    known, n = Remembered(), np.zeros(0, np.int64)

    def out() -> Iterator[pa.RecordBatch]:
        for i in range(0, len(known), 1 << 15):
            j = min(i + (1 << 15), len(known))
            hashes = np.empty(len(known), _U)
            hashes[known.rows] = known.hashes
            yield pa.RecordBatch.from_arrays([strings(known.data, known.starts[i:j], known.lengths[i:j]), pa.array(hashes[i:j].view(np.int64)), pa.array(n[i:j])], ["word", "h", "n"])

    for batch in batches:
        for _, part in Texts.of(batch.column(0)).parts(SLICE):
            code, rows = remember(known, words(lower_ascii(part)))
            n = np.concatenate([n, np.zeros(len(known) - len(n), np.int64)])
            n[rows] += np.bincount(code, minlength=len(rows))
            if known.bytes() > WORD_BYTES:
                yield from out()
                known, n = Remembered(), np.zeros(0, np.int64)
            release()
    yield from out()
    release(0)


def _write_words(root: str):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        t = Texts.of(table.column("word"))
        h, n = table.column("h").to_numpy().view(_U), table.column("n").to_numpy()
        raw = t.data.tobytes()
        order = np.argsort(h, kind="stable")
        h = h[order]
        for i, j in ((i, j) for _, i, j in _sections(h.view(np.int64)) if j - i > 1):  # of words of one hash, by bytes
            order[i:j] = sorted(order[i:j], key=lambda k: raw[t.bounds[k] : t.bounds[k + 1]])
        lengths = np.diff(t.bounds)[order]
        ends = np.cumsum(lengths)
        write_arrays(f"{root}/words/{shard}", h=h, n=n[order], start=ends - lengths, length=lengths.astype("<u4"), data=ragged(t.data, t.bounds[:-1][order], lengths))
        return pa.table({"shard": pa.array([shard], pa.int64()), "size": pa.array([len(h)], pa.int64())})

    return run


class Vocabulary:
    """base: the ids before each shard's."""

    def __init__(self, root: str, bits: int, base: np.ndarray, n_docs: int):
        self.root, self.bits, self.base, self.n_docs = root, bits, base, n_docs

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count) of each word; UNKNOWN and 0 for others."""
        ids, counts = np.full(len(hashes), UNKNOWN, np.int64), np.zeros(len(hashes), np.int64)
        order = np.argsort(hashes)
        for shard, i, j in _sections(shard_of(hashes[order], self.bits)):
            m = mapped(f"{self.root}/words/{shard}")
            if m is None:
                continue
            todo = order[i:j]
            at = np.searchsorted(m["h"], hashes[todo])
            while len(todo):
                there = at < len(m["h"])
                there[there] = m["h"][at[there]] == hashes[todo[there]]
                todo, at = todo[there], at[there]
                n = (ends - starts)[todo]
                good = m["length"][at] == n
                same = todo[good]
                some = ragged(m["data"], m["start"][at[good]], n[good])
                good[good] = same_bytes(data, starts[same], some, np.cumsum(n[good]) - n[good], n[good])
                ids[todo[good]], counts[todo[good]] = self.base[shard] + at[good] + 2, m["n"][at[good]]
                todo, at = todo[~good], at[~good] + 1
        return ids, counts

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, place in it) of words; -1 for the start and the end."""
        shard = np.searchsorted(self.base, ids - 2, side="right") - 1
        return np.where(ids >= 2, shard, -1), ids - 2 - self.base[np.maximum(shard, 0)]

    def read(self, folder: str, field: str, ids: np.ndarray, special: int) -> np.ndarray:
        """A field of each id's word; `special` for the start and the end, 0 for unknown words."""
        out = np.where(ids == UNKNOWN, 0, special).astype(np.int64)
        shard, place = self.places(ids)
        order = np.argsort(ids, kind="stable")
        for s, i, j in _sections(shard[order]):
            if s >= 0 and (m := mapped(f"{self.root}/{folder}/{s}")) is not None:
                out[order[i:j]] = m[field][place[order[i:j]]]
        return out

    def sequences(self, part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All documents' starts, words and ends in a row: (id, count, document, place in it) of each."""
        p = words(lower_ascii(part))
        hashes = p.hashes()
        code, first = p.exact_codes(hashes)
        ids, counts = self.find(p.texts.data, p.starts[first], p.ends[first], hashes[first])
        n = p.counts() + 2
        bounds = np.concatenate([[0], np.cumsum(n)])
        row = np.repeat(np.arange(len(part)), n)
        place = np.arange(len(row)) - bounds[row]
        inner = np.ones(len(row), bool)
        inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
        seq, count = np.full(len(row), START, np.int64), np.full(len(row), self.n_docs, np.int64)
        seq[bounds[1:] - 1] = END
        seq[inner], count[inner] = ids[code], counts[code]
        return seq, count, row, place


# --- n-grams ---------------------------------------------------------------------------------------------------------


def chain(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of its context and its last id."""
    return mix(key * _FACTOR + (ids + 1).astype(_U))


def gram_key(columns: list[np.ndarray]) -> np.ndarray:
    key = np.zeros(len(columns[0]), _U)
    for c in columns:
        key = chain(key, c)
    return key


def distinct(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ids, in ascending order, and the sums of their counts."""
    if len(columns) == 1:
        key, n = summed(columns[0], n)
        return [key], n
    if len(columns) == 2 and (not len(n) or max(int(c.max()) for c in columns) < 1 << 31):
        key, n = summed(columns[0] << 32 | columns[1], n)
        return [key >> 32, key & 0xFFFFFFFF], n
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(n[order], at) if len(at) else n


def _plane(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def pack(columns: list[np.ndarray], n: np.ndarray) -> bytes:
    """Ascending rows of ids and their counts: differences of the first ids, byte planes, zstandard."""
    first = np.diff(columns[0], prepend=0)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(_plane(x) for x in [first, *columns[1:], n]))


def unpack(block: bytes, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(width + 1, 8, -1)
    out = [np.ascontiguousarray(x.T).view("<u8").reshape(-1).astype(np.int64) for x in raw]
    out[0] = np.cumsum(out[0])
    return out[:width], out[width]


class Gathered:
    """Distinct n-grams of one order with their route: the hash that tells the shard."""

    def __init__(self, order: int, bits: int):
        self.order, self.bits = order, bits
        self.light: list[tuple] = []
        self.heavy: list[tuple] = []
        self.held = 0

    def add(self, columns: list[np.ndarray], n: np.ndarray, heavy: np.ndarray) -> None:
        for mine, use in ((self.light, ~heavy), (self.heavy, heavy)):
            mine.append(distinct([c[use] for c in columns], n[use]))
            self.held += len(mine[-1][1])
        if self.held > HELD_GRAMS:
            self.join()

    def join(self) -> None:
        for name in ("light", "heavy"):
            parts = getattr(self, name)
            if len(parts) > 1:
                setattr(self, name, [distinct([np.concatenate(c) for c in zip(*[p[0] for p in parts], strict=True)], np.concatenate([p[1] for p in parts]))])
        self.held = sum(len(x[1]) for x in [*self.light, *self.heavy])

    def rows(self, bits: int | None = None) -> Iterator[dict]:
        """A block for each shard, heavy contexts apart; nothing is held afterwards."""
        self.join()
        for heavy, parts in ((False, self.light), (True, self.heavy)):
            for columns, n in parts:
                shard = shard_of(gram_key(columns if heavy else columns[:-1]), self.bits if bits is None else bits)
                order = np.argsort(shard, kind="stable")
                columns, n = [c[order] for c in columns], n[order]
                for s, i, j in _sections(shard[order]):
                    yield {"level": self.order, "shard": s, "heavy": heavy, "block": pack([c[i:j] for c in columns], n[i:j])}
        self.light, self.heavy, self.held = [], [], 0

    def full(self) -> bool:
        return self.held > HELD_GRAMS // 2


BLOCKS = "level int, shard long, heavy boolean, block binary"
_BLOCKS = pa.schema([("level", pa.int32()), ("shard", pa.int64()), ("heavy", pa.bool_()), ("block", pa.binary())])


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    some, size = [], 0
    for r in rows:
        some.append(r)
        size += len(r["block"] or b"") + 64
        if size > most:
            yield pa.RecordBatch.from_pylist(some, schema)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


class _Levels:
    """What a task gathers for several orders."""

    def __init__(self, bits: dict[int, int], coarse: int):
        self.by = {m: Gathered(m, b) for m, b in bits.items()}
        self.coarse = coarse

    def rows(self, always: bool) -> Iterator[dict]:
        for g in self.by.values():
            if always or g.full():
                yield from g.rows(min(g.bits, self.coarse))


def _grams(vocab: Vocabulary, order: int, bits: dict[int, int], heavy: int, coarse: int):
    """All n-grams of the highest order; of lower ones those at a document's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        levels = _Levels(bits, coarse)
        for batch in batches:
            for _, part in Texts.of(batch.column(0)).parts(SLICE):
                seq, count, _, place = vocab.sequences(part)
                for m, g in levels.by.items():
                    at = np.flatnonzero(place >= m - 1 if m == order else place == m - 1)
                    often = np.min([count[at - j] for j in range(1, m)], axis=0) > heavy if len(at) else np.zeros(0, bool)
                    g.add([seq[at - m + 1 + j] for j in range(m)], np.ones(len(at), np.int64), often)
                yield from _batches(levels.rows(False), _BLOCKS)
                release()
        yield from _batches(levels.rows(True), _BLOCKS)
        release(0)

    return run


def _split(order: int, bits: int):
    """Blocks dealt by few bits of the route -> blocks by all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, last = _Levels({order: bits}, bits), None
        g = levels.by[order]
        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != last and last is not None:
                    yield from _batches(levels.rows(True), _BLOCKS)
                last = r["shard"]
                columns, n = unpack(r["block"], order)
                g.add(columns, n, np.full(len(n), r["heavy"]))
                yield from _batches(levels.rows(False), _BLOCKS)
        yield from _batches(levels.rows(True), _BLOCKS)
        release(0)

    return run


MERGED = f"{BLOCKS}, kind string, key long, s long, n1 long, n2 long, n3 long, n4 long"
_MERGED = pa.schema([*_BLOCKS, ("kind", pa.string()), *[(c, pa.int64()) for c in ("key", "s", "n1", "n2", "n3", "n4")]])


def _of_counts(a: np.ndarray) -> dict:
    return {"s": int(a.sum()), **{f"n{k}": int((a == k).sum()) for k in (1, 2, 3, 4)}}


def _contexts(key: np.ndarray, a: np.ndarray) -> dict[str, np.ndarray]:
    """For each context the sum of its adjusted counts and the numbers of tokens with 1, 2 and more."""
    ctx, s, n1, n2, n3 = summed(key, a, (a == 1).astype(np.int64), (a == 2).astype(np.int64), (a > 2).astype(np.int64))
    return {"ctx": ctx, "s": s, "n1": n1, "n2": n2, "n3": n3}


def _merge(vocab: Vocabulary, order: int, lower_bits: int, heavy: int, coarse: int):
    """A shard's blocks -> its file; counts of counts, sums of heavy contexts, and the next lower order's blocks as rows."""

    def rows(table: pa.Table) -> Iterator[dict]:
        none = dict.fromkeys(_MERGED.names)
        shard, got = table.column("shard")[0].as_py(), {}
        for is_heavy in (False, True):
            blocks = [unpack(b.as_py(), order) for b, h in zip(table.column("block"), table.column("heavy"), strict=True) if h.as_py() == is_heavy]
            if blocks:
                got[is_heavy] = distinct([np.concatenate(c) for c in zip(*[x[0] for x in blocks], strict=True)], np.concatenate([x[1] for x in blocks]))
        keys, counts, light = [], [], _contexts(np.zeros(0, _U), np.zeros(0, np.int64))
        lower = Gathered(order - 1, lower_bits)
        for is_heavy, (columns, a) in got.items():
            ctx = gram_key(columns[:-1])
            keys.append(chain(ctx, columns[-1]))
            counts.append(a)
            if is_heavy:
                x = _contexts(ctx, a)
                for i in range(len(x["s"])):
                    yield none | {"kind": "context", "key": int(x["ctx"][i : i + 1].view(np.int64)[0]), **{c: int(x[c][i]) for c in ("s", "n1", "n2", "n3")}}
            else:
                light = _contexts(ctx, a)
            yield none | {"kind": "counts", "key": 0} | _of_counts(a)
            one = np.ones(len(a), np.int64)  # each token in front counts once
            if order > 2:
                often = np.min([vocab.read("words", "n", c, vocab.n_docs) for c in columns[1:-1]], axis=0) > heavy
                lower.add(columns[1:], one, often)
            else:
                ids, n = distinct([columns[-1]], one)
                where = vocab.places(ids[0])[0]
                for s, i, j in _sections(where):
                    yield none | {"kind": "lower", "level": 1, "shard": s, "heavy": False, "block": pack([ids[0][i:j]], n[i:j])}
        if order > 2:
            for r in lower.rows(min(lower_bits, coarse)):
                yield none | {"kind": "lower"} | r
        key, a = np.concatenate(keys), np.concatenate(counts)
        at = np.argsort(key)
        write_arrays(f"{vocab.root}/grams{order}/{shard}", key=key[at], a=small(a[at]), ctx=light["ctx"], **{c: small(light[c]) for c in ("s", "n1", "n2", "n3")})

    def run(table: pa.Table) -> pa.Table:
        forget()
        batches = list(_batches(rows(table), _MERGED))
        release(0)
        return pa.Table.from_batches(batches, _MERGED)

    return run


def _merge_words(vocab: Vocabulary):
    """Numbers of distinct tokens in front of each word of a shard -> a file in the words' order."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        size = int(vocab.base[shard + 1] - vocab.base[shard]) if shard >= 0 else 2
        a = np.zeros(size, np.int64)
        for block in table.column("block"):
            (ids,), n = unpack(block.as_py(), 1)
            a[ids - 2 - vocab.base[shard] if shard >= 0 else ids] += n
        write_arrays(f"{vocab.root}/fronts/{shard}", a=small(a))
        row = dict.fromkeys(_MERGED.names) | {"kind": "counts", "shard": shard, "key": int(a[END]) if shard < 0 else 0, **_of_counts(a), "level": int((a > 2).sum())}
        return pa.Table.from_pylist([row], _MERGED)

    return run


def _write_contexts(root: str, order: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        key = table.column("key").to_numpy().view(_U)
        at = np.argsort(key)
        write_arrays(f"{root}/contexts{order}/{shard}", ctx=key[at], **{c: table.column(c).to_numpy()[at] for c in ("s", "n1", "n2", "n3")})
        return pa.table({"shard": pa.array([shard], pa.int64())})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts 1, 2 and more, from the numbers of n-grams with counts 1 to 4."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return d if all(0 <= x <= k for k, x in enumerate(d, 1)) else (0.5, 1.0, 1.5)


class Model:
    """What a worker needs besides the files."""

    def __init__(self, vocab: Vocabulary, order: int, tokens: int, size: int, heavy: int):
        self.vocab, self.order, self.tokens, self.size, self.heavy = vocab, order, tokens, size, heavy
        self.discounts: dict[int, tuple[float, float, float]] = {}
        self.bits: dict[int, int] = {}
        self.fronts, self.free, self.end_fronts = 0, 1.0, 0  # distinct bigrams, mass of the lowest order, those that end

    def _cut(self, order: int, a: np.ndarray) -> np.ndarray:
        """Counts less their discounts."""
        return a - np.array([0.0, *self.discounts[order]])[np.minimum(a, 3)]

    def _find(self, folder: str, bits: int, route: np.ndarray, key: np.ndarray, by: str, fields: tuple[str, ...]) -> list[np.ndarray]:
        """Fields of each key's entry in the shard that its route tells, 0 where there is none."""
        out = [np.zeros(len(key), np.int64) for _ in fields]
        shard = shard_of(route, bits)
        order = np.lexsort((key, shard))
        for s, i, j in _sections(shard[order]):
            m = mapped(f"{self.vocab.root}/{folder}/{s}")
            if m is None or not len(m[by]):
                continue
            some = order[i:j]
            at = np.minimum(np.searchsorted(m[by], key[some]), len(m[by]) - 1)
            hit = m[by][at] == key[some]
            for x, f in zip(out, fields, strict=True):
                x[some[hit]] = m[f][at[hit]]
        return out

    def probabilities(self, seq: np.ndarray, count: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each token that isn't a start, behind up to order - 1 tokens of its document."""
        at = np.flatnonzero(place > 0)
        if not self.tokens:
            return np.ones(len(at))
        ids, inverse = np.unique(seq[at], return_inverse=True)
        a = self.vocab.read("fronts", "a", ids, self.end_fronts)
        p = (self._cut(1, a) / max(1, self.fronts) + self.free / (self.size + 1))[inverse]
        key, known = np.zeros(len(at), _U), np.ones(len(at), bool)
        often = np.full(len(at), np.iinfo(np.int64).max)
        for m in range(2, self.order + 1):
            # the context of m - 1 tokens before each place
            use = place[at] >= m - 1
            before = np.where(use, at - (m - 1), at)
            known &= use & (seq[before] != UNKNOWN)
            often = np.minimum(often, count[before])
            here = np.flatnonzero(known)
            key = gram_key([seq[at[here] - j] for j in range(m - 1, 0, -1)])
            heavy, gram = often[here] > self.heavy, chain(key, seq[at[here]])
            ctx, first, of_ctx = np.unique(key, return_index=True, return_inverse=True)
            stats, big = np.zeros((4, len(ctx))), heavy[first]
            for use_big, folder in ((False, f"grams{m}"), (True, f"contexts{m}")):
                some = np.flatnonzero(big == use_big)
                for j, x in enumerate(self._find(folder, self.bits[m], ctx[some], ctx[some], "ctx", ("s", "n1", "n2", "n3"))):
                    stats[j, some] = x
            grams, first, of_gram = np.unique(gram, return_index=True, return_inverse=True)
            route = np.where(heavy, gram, key)[first]
            (a,) = self._find(f"grams{m}", self.bits[m], route, grams, "key", ("a",))
            s, *n = stats[:, of_ctx]
            free = sum(d * x for d, x in zip(self.discounts[m], n, strict=True))
            seen = s > 0
            p[here[seen]] = (self._cut(m, a)[of_gram][seen] + free[seen] * p[here[seen]]) / s[seen]
        return p


def _shuffled(blocks: DataFrame, order: int, bits: int, coarse: int) -> DataFrame:
    """Blocks by shard; first in two steps where shards outnumber what a task deals."""
    if bits > coarse:
        by_part = blocks.repartition("shard").sortWithinPartitions("shard")
        blocks = by_part.select("level", "shard", "heavy", "block").mapInArrow(_split(order, bits), BLOCKS)
    return blocks.groupBy("shard")


def train(docs: DataFrame, *, order: int = ORDER, shard_words: int = SHARD_WORDS, shard_tokens: int = SHARD_TOKENS, coarse: int = COARSE) -> Model:
    """Count all of docs (text)."""
    if order < 2:
        raise ValueError("an order of 2 at least")
    spark = docs.sparkSession
    at = stage_path(spark, "language-model")
    root, texts = local_root(at), docs.select(F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(_count_words, "word string, h long, n long").groupBy("word").agg(F.first("h").alias("h"), F.sum("n").alias("n"))
    counted = staged(counted, "words", f"{at}/counted")
    n_docs = texts.count()
    v, n = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    word_bits = shard_bits(v, shard_words)
    by_shard = counted.withColumn("shard", F.shiftrightunsigned("h", 64 - word_bits)).groupBy("shard")
    sizes = staged(by_shard.applyInArrow(_write_words(root), "shard long, size long"), "sizes", f"{at}/sizes")
    base = np.zeros((1 << word_bits) + 1, np.int64)
    for r in sizes.collect():  # a row for each 2^18 words
        base[r["shard"] + 1] = r["size"]
    vocab = Vocabulary(root, word_bits, np.cumsum(base), n_docs)
    tokens, bits, narrow = n + n_docs, shard_bits(n + n_docs, shard_tokens), coarse.bit_length() - 1
    heavy = max(shard_tokens // 4, tokens >> 18)
    model = Model(vocab, order, tokens, v + (n_docs > 0), heavy)
    if not n_docs:
        return model
    grams = texts.mapInArrow(_grams(vocab, order, {m: bits for m in range(order, 1, -1)}, heavy, narrow), BLOCKS)
    if order > 2:  # the lower orders' part is read later
        grams = staged(grams, "grams", f"{at}/blocks")
    lower = None
    for m in range(order, 1, -1):
        model.bits[m] = bits
        blocks = grams.filter(F.col("level") == m) if order > 2 else grams
        blocks = blocks if lower is None else blocks.unionByName(lower.filter("kind = 'lower'").select(*blocks.columns))
        merged = _shuffled(blocks, m, bits, narrow).applyInArrow(_merge(vocab, m, bits, heavy, narrow), MERGED)
        lower = staged(merged, "merged", f"{at}/merged{m}")
        model.discounts[m] = discounts(*lower.filter("kind = 'counts'").agg(*[F.sum(f"n{k}") for k in (1, 2, 3, 4)]).first())
        contexts = lower.filter("kind = 'context'").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("s", "n1", "n2", "n3")])
        contexts = contexts.withColumn("shard", F.shiftrightunsigned("key", 64 - bits)).groupBy("shard")
        with freed_shuffles(spark):
            contexts.applyInArrow(_write_contexts(root, m), "shard long").write.parquet(f"{at}/wrote{m}")
    words_ = lower.filter("kind = 'lower'").groupBy("shard").applyInArrow(_merge_words(vocab), MERGED)
    facts = staged(words_, "fronts", f"{at}/merged1").agg(*[F.sum(f"n{k}") for k in (1, 2, 3, 4)], F.sum("s"), F.sum("level"), F.sum("key")).first()
    model.discounts[1] = discounts(*facts[:4])
    model.fronts, model.end_fronts = facts[4], facts[6]
    free = sum(d * x for d, x in zip(model.discounts[1], (facts[0], facts[1], facts[5]), strict=True))
    model.free = free / model.fronts
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (log10 probability) of each whole text."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, part in Texts.of(batch.column(1)).parts(SLICE):
                seq, count, row, place = model.vocab.sequences(part)
                p = model.probabilities(seq, count, place)
                use = place > 0
                row, count = row[use], count[use]
                of_base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.size + 1)))
                sums = [np.bincount(row, weights=x, minlength=len(part)) for x in (of_base, np.log10(p))]
                n, n_known = np.bincount(row, minlength=len(part)), np.bincount(row[count > 0], minlength=len(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(part)), *[pa.array(x.astype(np.int64)) for x in (n, n_known)], *[pa.array(x) for x in sums]], ["doc_id", "n_tokens", "n_known", "base_score", "score"])
                release()
        release(0)

    return base.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def perplexity(scored: DataFrame) -> DataFrame:
    """Adds perplexity and base_perplexity, per token."""
    return scored.withColumns({name: F.pow(F.lit(10.0), -F.col(c) / F.col("n_tokens")) for name, c in (("perplexity", "score"), ("base_perplexity", "base_score"))})


def op12_kneser_ney_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs.filter(~held_out()))
    scored = score(docs, model).withColumns({"held_out": held_out(), "train_tokens": F.lit(model.tokens).cast("long")})
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op12_kneser_ney_lm": op12_kneser_ney_lm}
SQL: dict[str, str] = {}
