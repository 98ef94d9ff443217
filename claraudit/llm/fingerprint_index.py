"""Substring dedup over a log-structured fingerprint index (operator 4).

A window is 13 consecutive words (runs of bytes other than white space) of one document; its fingerprint is a key of 56
bits. The index is a log under one path:

* texts: each batch's documents in *slices* of a few MB, a row each, bucketed by slice number. Texts are never shuffled.
* runs: sorted immutable runs of fingerprints with the place (slice, word) where each was first seen, bucketed by the
  key's leading bits. The runs' keys are disjoint. Two runs of one level are compacted into one of the next, in the same
  pass that merge-joins them with a new batch.
* a manifest for each generation, by which an index is opened again, in another session too.

A new batch is handled so:

1. Its texts are appended. A pass over the slices gives each one's fingerprints, sorted, from the smallest document that
   holds them. What a later document of the slice repeats is verified word by word and settled there and then, so a
   window that a third of all documents hold is shipped once for each slice, not once for each document.
2. By bucket, the fingerprints are merge-joined with the runs. What a run holds, or a smaller document of the batch, may be
   a repeat: an *ask*, from a place to the place where the window was first seen. Fresh fingerprints become a run.
3. Verification: asks of consecutive places become passages, and a slice states its passages by a 160-bit digest over
   their words. Distinct statements go to the slice of the first place, which compares them with its own words.
4. Keys of which two different windows were met (by chance, 2**-56 a pair) are decided by the words themselves: all
   windows of these keys are grouped by their words. So results are exact whatever the keys do.
5. Each slice's texts are cut: every word that a repeated window covers is removed.

Rows shuffled are proportional to the text: a row is one slice's fingerprints of one bucket, and where buckets are more
than 2**COARSE_BITS, these travel in two steps, by coarse buckets first.

Defined results: null or blank text has no words; windows that only repeat inside their own document, or in rows of the
same doc_id, aren't repeats; a null doc_id counts as larger than all others; very long texts are one slice; an empty table
gives no rows. Columns named in `keep` are carried along whatever their names; others are never read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claraudit.llm.common import drop_path, forget, freed_shuffles, release, shuffle_partitions, stage_path, staged, text_slices
from claraudit.llm.words import Pieces, Texts, ragged, windows, words

WINDOW, BATCHES, KEY_BITS, FANOUT = 13, 3, 56, 2
#: Text bytes of a slice and of a bucket, about; leading bits by which fingerprints travel at once.
SLICE, BUCKET_BYTES, COARSE_BITS = 8 << 20, 4 << 20, 13
#: Fingerprints that are cut anew together; keys decided by words in one pass.
TOGETHER, DECIDED = 4 << 20, 1 << 20
_U = np.uint64
_LAST = (1 << 63) - 1

TEXTS = "slice long, content binary"
PRINTS = "bucket long, keys binary, slices binary, places binary, docs binary, b_slice long, b_places binary, a_slices binary, a_places binary, marks binary, unsure binary"
RUN = "bucket long, keys binary, slices binary, places binary"
PASSAGE = "slice long, place long, n long, a_slice long, a_place long, digest binary"


def pack_ints(x: np.ndarray) -> bytes:
    """Non-negative 64-bit numbers as compressed byte planes, without those that hold zeros only."""
    import zstandard

    planes = x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8).T
    width = next((i for i in range(8, 0, -1) if len(x) and planes[i - 1].any()), 0)
    press = zstandard.ZstdCompressor(level=1)
    parts = [press.compress(np.ascontiguousarray(p).tobytes()) for p in planes[:width]]
    return np.array([len(x), width, *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def unpack_ints(raw: bytes) -> np.ndarray:
    import zstandard

    n, width = np.frombuffer(raw, "<u4", 2).tolist()
    out, press, at = np.zeros((n, 8), np.uint8), zstandard.ZstdDecompressor(), 8 + 4 * width
    for i, m in enumerate(np.frombuffer(raw, "<u4", width, 8).tolist()):
        out[:, i] = np.frombuffer(press.decompress(raw[at : at + m]), np.uint8)
        at += m
    return out.reshape(-1).view("<u8")


def pack_sorted(x: np.ndarray) -> bytes:
    return pack_ints(np.diff(x, prepend=x.dtype.type(0)).view(_U))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack_ints(raw), dtype=_U)


def pack_few(x: np.ndarray) -> bytes:
    """Numbers of which there are few distinct ones: these, and a code for each."""
    codes, own = pd.factorize(x, sort=True)
    first = pack_sorted(np.asarray(own, np.int64))
    return np.array([len(first)], "<u4").tobytes() + first + pack_ints(codes.astype(_U))


def unpack_few(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    return unpack_sorted(raw[4 : 4 + n]).view(np.int64)[unpack_ints(raw[4 + n :]).astype(np.int64)]


def _all(parts: list, how, kind) -> np.ndarray:
    return np.concatenate([how(x) for x in parts]) if parts else np.zeros(0, kind)


def _filled(table: pa.Table | pa.RecordBatch, name: str) -> list[bytes]:
    return [x for x in table.column(name).to_pylist() if x is not None]


def window_keys(t: Texts, size: int, key_bits: int) -> tuple[np.ndarray, np.ndarray, Pieces, np.ndarray]:
    """(key, index of the first word) of each window, the words and their hashes."""
    w = words(t)
    h = w.hashes()
    key, at = windows(h, w.first, size)
    return key >> _U(64 - key_bits), at, w, h


def _rows(**columns) -> pa.RecordBatch:
    """Rows of PRINTS; columns not given are null."""
    n = len(next(iter(columns.values())))
    fields = [x.split() for x in PRINTS.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * n), kinds[k]) for c, k in fields], [c for c, _ in fields])


def _slices(batch: int):
    """Documents to rows of TEXTS: the rows of a slice as one compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget()
        task, made, parts, total = TaskContext.get().partitionId(), 0, [], 0

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(parts)
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table.combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([batch << 46 | task << 22 | made]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["slice", "content"])

        for part in batches:
            sizes = np.diff(Texts.of(part.column(part.num_columns - 1)).bounds)
            for a, b in text_slices(sizes.tolist(), SLICE):
                if parts and total + int(sizes[a:b].sum()) > SLICE:
                    yield row()
                    made, parts, total = made + 1, [], 0
                parts.append(part.slice(a, b - a))
                total += int(sizes[a:b].sum())
        if parts:
            yield row()
        parts.clear()
        release(0)

    return run


def _content(raw: pa.Scalar) -> pa.Table:
    with pa.ipc.open_stream(raw.as_buffer()) as at:
        return at.read_all()


def _text(table: pa.Table) -> Texts:
    return Texts.of(table.column("_text"))


def _cells(key: np.ndarray, key_bits: int, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the sorted keys."""
    bucket = (key >> _U(key_bits - bits)).astype(np.int64)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    return list(zip(bucket[cut].tolist(), cut.tolist(), np.append(cut[1:], len(key)).tolist(), strict=True))


def _prints(size: int, key_bits: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = _content(raw)
                ids = table.column("_id").to_numpy()
                key, at, w, h = window_keys(_text(table), size, key_bits)
                if not len(key):
                    continue
                order = np.argsort(key, kind="stable")
                key, at = key[order], at[order]
                doc = ids[np.searchsorted(w.first, at, "right") - 1]
                same = np.flatnonzero(key[1:] == key[:-1])
                keep = np.ones(len(key), bool)
                if len(same):
                    twice = np.zeros(len(key), bool)
                    twice[same] = twice[same + 1] = True
                    k = np.flatnonzero(twice)
                    o = k[np.lexsort((at[k], doc[k], key[k]))]
                    at[k], doc[k] = at[o], doc[o]
                    new = np.flatnonzero(key[k] != np.concatenate([[~key[k][0]], key[k][:-1]]))
                    first = np.repeat(k[new], np.diff(np.append(new, len(k))))
                    code, alike = w.exact_codes(h)[0], np.ones(len(k), bool)
                    for j in range(size):
                        alike &= code[at[k] + j] == code[at[first] + j]
                    later = doc[k] > doc[first]
                    keep[k] = alike & ~later
                    unsure, marks = np.unique(key[k[~alike]]), np.sort(at[k[alike & later]])
                    if len(unsure):
                        yield _rows(bucket=[number % (1 << bits)], unsure=[pack_sorted(unsure)])
                    if len(marks):
                        yield _rows(bucket=[number % (1 << bits)], b_slice=[number], marks=[pack_sorted(marks.astype(np.int64))])
                key, at, doc = key[keep], at[keep], doc[keep]
                cells = _cells(key, key_bits, bits)
                one = np.zeros(max(y - x for _, x, y in cells), np.int64) + number
                yield _rows(
                    bucket=[b for b, _, _ in cells],
                    keys=[pack_sorted(key[x:y]) for _, x, y in cells],
                    slices=[pack_few(one[: y - x]) for _, x, y in cells],
                    places=[pack_ints(at[x:y].astype(_U)) for _, x, y in cells],
                    docs=[pack_few(doc[x:y]) for _, x, y in cells],
                )
                del key, at, doc, order, keep, w, h, table, one, same
                release()
        release(0)

    return run


def _split(key_bits: int, bits: int):
    """Rows of fingerprints in coarse buckets to rows in finer ones; other rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, total = [], 0

        def cut() -> pa.RecordBatch:
            key, sl, place, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key, kind="stable")
            key, sl, place, doc = key[order], sl[order], place[order], doc[order]
            cells = _cells(key, key_bits, bits)
            packed = {"keys": (pack_sorted, key), "slices": (pack_few, sl), "places": (pack_ints, place), "docs": (pack_few, doc)}
            return _rows(bucket=[b for b, _, _ in cells], **{c: [how(v[x:y]) for _, x, y in cells] for c, (how, v) in packed.items()})

        for batch in batches:
            other = batch.filter(pa.compute.is_null(batch.column("keys")))
            if len(other):
                yield other
            for row in batch.filter(pa.compute.is_valid(batch.column("keys"))).select(["keys", "slices", "places", "docs"]).to_pylist():
                key = unpack_sorted(row["keys"])
                parts.append((key, unpack_few(row["slices"]), unpack_ints(row["places"]), unpack_few(row["docs"]) if row["docs"] else np.zeros(len(key), np.int64)))
                total += len(key)
                if total > TOGETHER:
                    yield cut()
                    parts, total = [], 0
        if parts:
            yield cut()

    return run


def _merge(key_: tuple, new: pa.Table, old: pa.Table) -> pa.Table:
    """One bucket: new fingerprints against those of the runs."""
    release()
    bucket, out = int(key_[0].as_py()), []
    passed = new.filter(pa.compute.is_null(new.column("keys")))
    key, doc = _all(_filled(new, "keys"), unpack_sorted, _U), _all(_filled(new, "docs"), unpack_few, np.int64)
    at_slice, place = _all(_filled(new, "slices"), unpack_few, np.int64), _all(_filled(new, "places"), unpack_ints, _U)
    order = np.lexsort((place, at_slice, doc, key))
    key, doc, at_slice, place = key[order], doc[order], at_slice[order], place[order]
    old_key, old_slice, old_place = _all(_filled(old, "keys"), unpack_sorted, _U), _all(_filled(old, "slices"), unpack_few, np.int64), _all(_filled(old, "places"), unpack_ints, _U)
    counts = [int(np.frombuffer(x, "<u4", 1)[0]) for x in _filled(old, "keys")]
    taken = np.repeat(np.array(old.column("taken").to_pylist(), bool), counts)
    order = np.argsort(old_key, kind="stable")
    old_key, old_slice, old_place, taken = old_key[order], old_slice[order], old_place[order], taken[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    if len(old_key):
        i = np.minimum(np.searchsorted(old_key, key), len(old_key) - 1)
        held = old_key[i] == key
    else:
        i, held = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    ask = np.flatnonzero(held | (doc > doc[head]))
    if len(ask):
        a_slice, a_place = at_slice[head[ask]], place[head[ask]]
        was = held[ask]
        a_slice[was], a_place[was] = old_slice[i[ask[was]]], old_place[i[ask[was]]]
        order = np.lexsort((place[ask], at_slice[ask]))
        b, p, a_slice, a_place = at_slice[ask][order], place[ask][order], a_slice[order], a_place[order]
        cut = np.flatnonzero(np.diff(b, prepend=-1))
        spans = list(zip(cut.tolist(), np.append(cut[1:], len(b)).tolist(), strict=True))
        out.append(_rows(bucket=[bucket] * len(spans), b_slice=b[cut].tolist(), b_places=[pack_sorted(p[x:y]) for x, y in spans], a_slices=[pack_few(a_slice[x:y]) for x, y in spans], a_places=[pack_ints(a_place[x:y]) for x, y in spans]))
    fresh = first & ~held
    key, at_slice, place = key[fresh], at_slice[fresh], place[fresh]
    if taken.any():
        key, at_slice, place = (np.concatenate(x) for x in ((old_key[taken], key), (old_slice[taken], at_slice), (old_place[taken], place)))
        order = np.argsort(key, kind="stable")
        key, at_slice, place = key[order], at_slice[order], place[order]
    if len(key):
        out.append(_rows(bucket=[bucket], keys=[pack_sorted(key)], slices=[pack_few(at_slice)], places=[pack_ints(place)]))
    done = pa.Table.from_batches(out, _rows(bucket=[0]).schema)
    return pa.concat_tables([done, passed.cast(done.schema)])


def _joined(w: Pieces) -> tuple[bytes, np.ndarray]:
    """All words, each with one space behind it, and where each begins."""
    lengths = w.ends - w.starts
    at = np.concatenate([[0], np.cumsum(lengths + 1)])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    out[np.repeat(at[:-1], lengths) + np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = ragged(w.texts.data, w.starts, lengths)
    return out.tobytes(), at


def _digests(w: Pieces, place: np.ndarray, n: np.ndarray, size: int) -> list[bytes]:
    raw, at = _joined(w)
    view, ends = memoryview(raw), at[place + n + size - 1].tolist()
    return [hashlib.blake2b(view[a:b], digest_size=20).digest() for a, b in zip(at[place].tolist(), ends, strict=True)]


def _passages(size: int):
    """One slice's asks to passages with digests."""

    def run(key_: tuple, texts: pa.Table, asks: pa.Table) -> pa.Table:
        release()
        number, names = key_[0].as_py(), [x.split()[0] for x in PASSAGE.split(", ")]
        schema = pa.schema([(x, pa.binary() if x == "digest" else pa.int64()) for x in names])
        if not len(asks):
            return schema.empty_table()
        b, a = (_all(_filled(asks, c), how, _U).astype(np.int64) for c, how in (("b_places", unpack_sorted), ("a_places", unpack_ints)))
        a_slice = _all(_filled(asks, "a_slices"), unpack_few, np.int64)
        order = np.lexsort((b, a - b, a_slice))
        b, a, a_slice = b[order], a[order], a_slice[order]
        new = np.ones(len(b), bool)
        new[1:] = (np.diff(b) != 1) | (np.diff(a) != 1) | (np.diff(a_slice) != 0)
        cut = np.flatnonzero(new)
        n = np.diff(np.append(cut, len(b)))
        digest = _digests(words(_text(_content(texts.column("content")[0]))), b[cut], n, size)
        return pa.table([pa.array(x) for x in (np.full(len(cut), number), b[cut], n, a_slice[cut], a[cut])] + [pa.array(digest, pa.binary())], schema=schema)

    return run


def _compared(size: int, key_bits: int):
    """The keys of stated passages that the slice of the first place doesn't hold there."""

    def run(_: tuple, texts: pa.Table, stated: pa.Table) -> pa.Table:
        schema = pa.schema([("a_slice", pa.int64()), ("a_place", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("keys", pa.binary())])
        release()
        if not len(stated):
            return schema.empty_table()
        t = _text(_content(texts.column("content")[0]))
        place, n = stated.column("a_place").to_numpy(), stated.column("n").to_numpy()
        own = _digests(words(t), place, n, size)
        bad = [i for i, (x, y) in enumerate(zip(own, stated.column("digest").to_pylist(), strict=True)) if x != y]
        if not bad:
            return schema.empty_table()
        key, at, _, _ = window_keys(t, size, key_bits)
        keys = [pack_sorted(np.unique(key[np.searchsorted(at, place[i]) : np.searchsorted(at, place[i] + n[i])])) for i in bad]
        return stated.take(bad).select(schema.names[:-1]).append_column("keys", pa.array(keys, pa.binary())).cast(schema)

    return run


def _windows_of(keys: np.ndarray, size: int, key_bits: int):
    """All windows of the given sorted keys, by their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for number, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = _content(raw)
                key, at, w, _ = window_keys(_text(table), size, key_bits)
                at = at[np.isin(key, keys)]
                text, begins = _joined(w)
                doc = table.column("_id").to_numpy()[np.searchsorted(w.first, at, "right") - 1]
                grams = [text[x:y] for x, y in zip(begins[at].tolist(), begins[at + size].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number)), pa.array(at.astype(np.int64)), pa.array(doc), pa.array(grams, pa.binary())], ["slice", "place", "doc", "gram"])

    return run


def _cut(size: int, original: bool, names: list[str]):
    def run(_: tuple, texts: pa.Table, marks: pa.Table) -> pa.Table:
        table = _content(texts.column("content")[0])
        w = words(_text(table))
        alone = _all(_filled(marks, "marks"), unpack_sorted, _U).astype(np.int64)
        runs = marks.filter(pa.compute.is_valid(marks.column("place")))
        place, n = np.concatenate([alone, runs.column("place").to_numpy()]), np.concatenate([np.ones(len(alone), np.int64), runs.column("n").to_numpy()])
        total = len(w.starts)
        stays = np.cumsum(np.bincount(place, minlength=total + 1) - np.bincount(place + n + size - 1, minlength=total + 1))[:total] == 0
        bounds = np.concatenate([[0], np.cumsum(stays)])[w.first]
        count, kept = w.counts(), np.diff(bounds)
        raw, texts_ = w.texts.data.tobytes(), table.column("_text").to_pylist()
        starts, ends = w.starts[stays].tolist(), w.ends[stays].tolist()
        for i, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if not (original and kept[i] == count[i]):
                texts_[i] = b" ".join([raw[s:e] for s, e in zip(starts[x:y], ends[x:y], strict=True)]).decode("utf-8", "replace")
        table = table.drop_columns(["_id", "_text"]).append_column("_text", pa.array(texts_, pa.string()))
        return table.append_column("n_words", pa.array(count)).append_column("n_removed", pa.array(count - kept)).select(names)

    return run


class FingerprintIndex:
    """The log under `path`. add() takes a batch in and gives its texts without what is repeated; a log that was written
    before, by this session or another, goes on where it ended."""

    def __init__(self, spark: SparkSession, path: str | None = None, *, window: int = WINDOW, key_bits: int = KEY_BITS, fanout: int = FANOUT, coarse_bits: int = COARSE_BITS, bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.path = spark, path or stage_path(spark, "fingerprints")
        self.state = {"generation": 0, "window": window, "key_bits": key_bits, "fanout": fanout, "bytes": 0, "runs": [], "texts": [], "tables": shuffle_partitions(spark)}
        self.coarse, self.bucket_bytes, self.names = coarse_bits, bucket_bytes, {}
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root):
            states = [json.loads(r["value"]) for r in spark.read.text(f"{self.path}/manifest").collect()]  # a row a generation
            self.state = max(states, key=lambda x: x["generation"])

    def _table(self, at: str, schema: str, by: str) -> str:
        """The catalogue's name of a bucketed folder of the log, for as long as this object needs it."""
        if at not in self.names:
            self.names[at] = f"log_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self.names[at]} ({schema}) USING parquet CLUSTERED BY ({by}) INTO {self.state['tables']} BUCKETS LOCATION '{self.path}/{at}'")
        return self.names[at]

    def _write(self, rows: DataFrame, at: str, by: str) -> None:
        self.names[at] = f"log_{uuid.uuid4().hex}"
        with freed_shuffles(self.spark):
            rows.write.bucketBy(self.state["tables"], by).option("path", f"{self.path}/{at}").option("compression", "none").saveAsTable(self.names[at])

    def _forget(self, at: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(at, 'log_none')}")
        drop_path(self.spark, f"{self.path}/{at}")

    def _staged(self, name: str, rows: DataFrame) -> DataFrame:
        return staged(rows, name, f"{self.path}/work/{name}-{uuid.uuid4().hex}")

    def close(self) -> None:
        """Drop the names in the catalogue and intermediate tables, once the results have been read; the log stays."""
        drop_path(self.spark, f"{self.path}/work")
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = {}

    def drop(self) -> None:
        self.close()
        drop_path(self.spark, self.path)

    def _bits(self) -> int:
        need = max(1, self.state["bytes"] / self.bucket_bytes)
        return min(self.state["key_bits"] - 8, max(4, int(np.ceil(np.log2(need))), *[r["bits"] for r in self.state["runs"]]))

    def _runs(self, bits: int, gone: list[dict]) -> DataFrame:
        """All runs' fingerprints in buckets of `bits` bits; taken: those of runs that are compacted."""
        out = self.spark.createDataFrame([], f"{RUN}, taken boolean")
        for r in self.state["runs"]:
            rows = self.spark.table(self._table(r["at"], PRINTS, "bucket")).filter("keys is not null")
            if r["bits"] < bits:
                rows = rows.mapInArrow(_split(self.state["key_bits"], bits), PRINTS)
            rows = rows.select("bucket", "keys", "slices", "places", F.lit(r in gone).alias("taken"))
            out = rows if r is self.state["runs"][0] else out.unionByName(rows)
        return out

    def add(self, docs: DataFrame, *, text_bytes: int, original: bool = False, last: bool = False) -> DataFrame:
        """docs: `_id` long (null: none), any columns, and `_text` string as the last. Gives these without `_id`, cut, with
        n_words and n_removed. last: no batch follows, so runs go once they have been read. text_bytes: of this batch."""
        spark, s = self.spark, self.state
        size, key_bits, generation = s["window"], s["key_bits"], s["generation"] + 1
        s["bytes"] += text_bytes
        bits, texts, prints = self._bits(), f"texts/{generation:06d}", f"runs/{generation:06d}"
        self._write(docs.mapInArrow(_slices(generation), TEXTS), texts, "slice")
        slices = spark.table(self.names[texts])
        coarse = min(bits, self.coarse)
        found = spark.read.schema(TEXTS).parquet(f"{self.path}/{texts}").mapInArrow(_prints(size, key_bits, coarse), PRINTS)
        if coarse < bits:
            found = found.repartition("bucket").mapInArrow(_split(key_bits, bits), PRINTS)
        level = 0
        while sum(r["level"] == level for r in s["runs"]) >= s["fanout"] - 1:
            level += 1  # the level's runs and this batch's are enough for one of the next
        gone = [r for r in s["runs"] if r["level"] < level]
        merged = found.groupBy("bucket").cogroup(self._runs(bits, gone).groupBy("bucket")).applyInArrow(_merge, PRINTS)
        self._write(merged, prints, "bucket")
        for r in gone:
            self._forget(r["at"])
        s["runs"] = [*[r for r in s["runs"] if r not in gone], {"at": prints, "level": level, "bits": bits}]
        s["texts"], s["generation"] = [*s["texts"], texts], generation
        rows = spark.read.schema(PRINTS).parquet(f"{self.path}/{prints}")
        passages = self._verified(rows, slices)
        marks = self._staged("marks", rows.filter("marks is not null").select(F.col("b_slice").alias("slice"), "marks"))
        if last:
            for r in s["runs"]:
                self._forget(r["at"])
            s["runs"] = []
        else:
            spark.createDataFrame([(json.dumps(s),)], "value string").coalesce(1).write.text(f"{self.path}/manifest/generation={generation}")
        fields = [f for f in docs.schema.fields if f.name != "_id"]
        schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
        none = F.lit(None)
        both = marks.select("slice", "marks", none.cast("long").alias("place"), none.cast("long").alias("n")).unionByName(passages.select("slice", none.cast("binary").alias("marks"), "place", "n"))
        return slices.groupBy("slice").cogroup(both.groupBy("slice")).applyInArrow(_cut(size, original, [f.name for f in schema.fields]), schema)

    def _verified(self, rows: DataFrame, slices: DataFrame) -> DataFrame:
        """(slice, place, n): runs of windows that are repeats by their words."""
        size, key_bits, spark = self.state["window"], self.state["key_bits"], self.spark
        asks = rows.filter("b_places is not null").select(F.col("b_slice").alias("slice"), "b_places", "a_slices", "a_places")
        passages = self._staged("passages", slices.groupBy("slice").cogroup(asks.groupBy("slice")).applyInArrow(_passages(size), PASSAGE))
        # what is asked of a slice is bounded by its own passages, not by the number of copies
        stated = passages.select("a_slice", "a_place", "n", "digest").distinct()
        bad = []
        for at in self.state["texts"]:
            held = spark.table(self._table(at, TEXTS, "slice")).withColumnRenamed("slice", "a_slice")
            mine = stated.filter(F.shiftright("a_slice", 46) == int(at[-6:]))
            bad.append(held.groupBy("a_slice").cogroup(mine.groupBy("a_slice")).applyInArrow(_compared(size, key_bits), "a_slice long, a_place long, n long, digest binary, keys binary"))
        wrong = bad[0]
        for x in bad[1:]:
            wrong = wrong.unionByName(x)
        wrong = self._staged("wrong", wrong)
        unsure = rows.filter("unsure is not null").select(F.col("unsure").alias("keys")).unionByName(wrong.select("keys"))
        if unsure.isEmpty():
            return passages
        good = passages.join(wrong.select("a_slice", "a_place", "n", "digest"), ["a_slice", "a_place", "n", "digest"], "left_anti")
        return good.select("slice", "place", "n").unionByName(self._decided(unsure))

    def _decided(self, unsure: DataFrame) -> DataFrame:
        """(slice, place, n): the windows of some keys that are repeats, by grouping these keys' windows by their words."""

        def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(_all(batch.column(0).to_pylist(), unpack_sorted, _U).astype(np.int64))], ["key"])

        keys = self._staged("unsure", unsure.mapInArrow(flat, "key long").distinct())
        parts = -(-keys.count() // DECIDED)
        every = [self.spark.read.schema(TEXTS).parquet(f"{self.path}/{at}") for at in self.state["texts"]]
        out = None
        for i in range(parts):  # at most DECIDED keys at once, about, go to the tasks
            some = np.sort(np.array([r["key"] for r in keys.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == i).collect()], np.int64)).astype(_U)
            for x in every:
                found = x.mapInArrow(_windows_of(some, self.state["window"], self.state["key_bits"]), "slice long, place long, doc long, gram binary")
                out = found if out is None else out.unionByName(found)
        out = self._staged("undecided", out)
        least = out.groupBy("gram").agg(F.min("doc").alias("least"))
        now = F.shiftright("slice", 46) == self.state["generation"]
        return out.filter(now).join(least, "gram").filter("doc > least").select("slice", "place", F.lit(1).cast("long").alias("n"))


def dedup_substrings(docs: DataFrame, *, window: int = WINDOW, batches: int = BATCHES, keep: tuple[str, ...] = (), original: bool = False, **how) -> DataFrame:
    """doc_id, the columns of `keep`, text (kept words joined by a space; with `original`, a text that lost nothing stays as
    it is), n_words, n_removed. The documents go through an index of their own in batches of ascending doc_id."""
    spark = docs.sparkSession
    names = {c: f"_keep{i}" for i, c in enumerate(keep)}
    base = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_id"), *[F.col(c).alias(a) for c, a in names.items()], F.col("text").cast("string").alias("_text"))
    facts = base.agg(F.sum(F.octet_length("_text")).alias("bytes"), F.percentile_approx("_id", [i / batches for i in range(1, batches)], 1000).alias("cuts") if batches > 1 else F.array().alias("cuts")).first()
    index = FingerprintIndex(spark, window=window, **how)
    edges = [None, *sorted(set(facts["cuts"] or [])), None]
    share = -(-(facts["bytes"] or 0) // (len(edges) - 1))
    out = None
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (F.col("_id") > lo)
        if hi is not None:
            inside = inside & (F.col("_id") <= hi)
        found = index.add(base.filter(inside), text_bytes=share, original=original, last=k == len(edges) - 2)
        out = found if out is None else out.unionByName(found)
    out = staged(out, "cut")
    index.drop()
    return out.select(F.col("_doc").alias("doc_id"), *[F.col(a).alias(c) for c, a in names.items()], F.col("_text").alias("text"), "n_words", "n_removed")


def op4_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op4_fingerprint_index": op4_fingerprint_index}
SQL = {
    "op4_fingerprint_index": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS gram
  FROM w, unnest(generate_series(1, len(ws) - 12)) AS s(i) WHERE len(ws) >= 13),
f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram),
d AS (SELECT g.doc_id, g.i FROM g JOIN f ON g.gram = f.gram AND f.first < g.doc_id),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM d),
l AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
k AS (
  SELECT w.doc_id, w.ws, coalesce(len(l.ps), 0) AS n_removed,
    CASE WHEN l.ps IS NULL THEN w.ws ELSE list_filter(w.ws, lambda x, i: NOT list_contains(l.ps, i)) END AS kept
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM k
"""
}
