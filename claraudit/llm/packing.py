"""Best-fit packing with certified bounds (operator 3).

Pieces of tokenised documents go into sequences of a fixed capacity. Pieces are dealt over partitions by a hash of their
row, or, where documents have an order to keep, by ranges of it, so that neighbouring sequences hold neighbouring documents
and sequence numbers ascend with the order. Each partition runs best-fit decreasing and certifies its number of sequences by dual-feasible-function lower bounds. A
partition whose number equals its bound is done, but for its emptiest sequence, whose room is only due to rounding. One
with a gap keeps its well-filled sequences. The pieces of the emptiest ones go into an exchange: they are dealt anew,
mixed with those of other partitions, and packed again, until the exchange fits one partition or for a stated number of
rounds. The same bounds over the lengths of all pieces together certify the whole.

Defined results: null or empty text is a document of the end id alone; repeated rows are packed as often as they occur;
doc_id may be null or repeated; an empty table gives no rows; other columns are never read. A document that is longer than
the capacity by millions of times makes its partition's group as long as its pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claraudit.llm.common import bucket, release, staged
from claraudit.llm.tokens import SLICE_BYTES, encoder, vocabulary, with_end
from claraudit.llm.words import Texts

CAPACITY, PIECES, ROUNDS = 2048, 2048, 4
#: row: a number of the document, distinct or at least ascending with the order to keep.
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"
PLACED = f"{PIECE}, sequence_id long, offset long"


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing of `sizes` has fewer bins."""
    return bound_of_counts(np.bincount(sizes, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of_counts(n: np.ndarray, capacity: int = CAPACITY) -> int:
    """The same for n[x] items of size x: the best of two families of dual-feasible functions.

    A dual-feasible function maps a share of the capacity to a number from 0 to 1 so that shares that fit one bin never
    map to more than 1 together; the mapped sum is then a bound. Family one, for a cut-off c: shares above 1 - c count
    1, those below c count 0, others themselves. Family two, for k: x counts floor((k + 1) x) / k, or itself where
    (k + 1) x is an integer.
    """
    if not n.any():
        return 0
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((n * x).sum()) // capacity)
    amount, count = np.concatenate([[0], np.cumsum(n * x)]), np.concatenate([[0], np.cumsum(n)])
    for c in np.flatnonzero(n[: capacity // 2 + 1]).tolist():
        large = int(count[-1] - count[capacity - c + 1])
        middle = int(amount[capacity - c + 1] - amount[c])
        best = max(best, large + -(-middle // capacity))
    for k in range(1, 33):
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, x * k, (k + 1) * x // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((n * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset in it) of each item, and the number of bins."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = bisect_left(room, (size, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            left, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - left
        if left > size:
            insort(room, (left - size, b))
    return bins, offsets, made


def cut_pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length): pieces of the capacity, the first one shorter where n isn't a multiple."""
    head = n % capacity if n > capacity else n
    out = [(0, head)] if head else []
    return out + [(a, capacity) for a in range(head, n, capacity)]


def token_pieces(docs: DataFrame, *, tokenizer: str | None = None, splits: str = "spaced", end_id: int = 0, capacity: int = CAPACITY, order: str | None = None) -> DataFrame:
    """A row for each piece of each whole document, without any shuffle. order: a column of distinct numbers from 0 on."""
    vocab = tokenizer or vocabulary("byte_bpe_50k.json")
    own = F.lit(None).cast("long") if order is None else F.col(order).cast("long")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, at = encoder(vocab, splits), TaskContext.get().partitionId() << 36
        for batch in batches:
            names, numbers = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            numbers = [at + i if x is None else x for i, x in enumerate(numbers)]
            at += len(names)
            for a, part in Texts.of(batch.column(1)).parts(SLICE_BYTES):
                ids, bounds = with_end(*enc.encode(part), end_id)
                raw, rows = memoryview(ids.astype("<u4", copy=False).tobytes()), []
                for name, number, lo, hi in zip(names[a:], numbers[a:], bounds[:-1].tolist(), bounds[1:].tolist(), strict=False):
                    for k, (s, n) in enumerate(cut_pieces(hi - lo, capacity)):
                        rows.append((name, k, s, n, zlib.crc32(raw[4 * (lo + s) : 4 * (lo + s + n)]), number))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECE.split(", ")])
                release()
        release(0)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), own).mapInArrow(encode, PIECE)


def _packer(r: int, last: bool, capacity: int):
    """Packs one partition in round r; unless it is the last, the emptiest sequences of a partition with a gap aren't done."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        release()
        sizes = rows["length"].to_numpy(np.int64)
        bins, offsets, made = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        filled = np.bincount(bins, weights=sizes, minlength=made)
        stays = np.ones(made, bool)
        if not last:  # with a gap, as many as hold the room of twice the gap; else the emptiest one, for the rounding
            order = np.argsort(filled, kind="stable")
            room = np.cumsum(capacity - filled[order])
            stays[order[: max(2, int(np.searchsorted(room, 2 * capacity * (made - bound))) + 1) if made > bound else 1]] = False
        rows["sequence_id"] = (np.int64(r) << 56) + (np.int64(key[0]) << 24) + bins
        rows["offset"], rows["done"], rows["bins"], rows["bound"] = offsets, stays[bins], made, bound
        return rows.drop(columns="part")

    return one


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, per_partition: int = PIECES, rounds: int = ROUNDS, ordered: bool = False) -> DataFrame:
    """Adds sequence_id and offset, the partition's `bins` and certified `bound`, and `bound_all` of the whole. Needs the
    columns of PIECE. ordered: rows are numbered from 0 in an order to keep."""
    todo = pieces
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # `capacity` rows at most
    left, done = sum(lengths.values()), []
    whole = bound_of_counts(np.array([lengths.get(x, 0) for x in range(capacity + 1)], np.int64), capacity)
    last_row = (pieces.agg(F.max("row").alias("r")).first()["r"] or 0) if ordered else 0
    for r in range(rounds):
        parts = max(1, -(-left // per_partition))
        last = r == rounds - 1 or parts == 1
        part = F.floor(F.col("row") * F.lit(float(parts)) / (last_row + 1)).cast("long") if ordered else bucket(parts, "row", "piece", salt=r + 1)
        dealt = todo.select(*[x.split()[0] for x in PIECE.split(", ")], part.alias("part"))
        placed = staged(dealt.groupBy("part").applyInPandas(_packer(r, last, capacity), f"{PLACED}, done boolean, bins long, bound long"), f"packed{r}")
        done.append(placed.filter("done").drop("done"))
        todo = placed.filter("not done")
        left = 0 if last else todo.count()
        if not left:
            break
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumn("bound_all", F.lit(whole).cast("long"))


def pack_documents(docs: DataFrame, *, capacity: int = CAPACITY, order: str | None = None, **how) -> DataFrame:
    """Tokenise, cut and pack; order: a column that numbers the documents from 0 on, to be kept."""
    return pack(staged(token_pieces(docs, capacity=capacity, order=order, **how), "pieces"), capacity=capacity, ordered=order is not None)


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound", "bound_all")


QUERIES = {"op3_best_fit": op3_best_fit}
SQL: dict[str, str] = {}
