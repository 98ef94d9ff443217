"""Token-ID output (operator 9): ids in bit-plane form, with a chunk index, in ascending document order.

A file is a Parquet table without Parquet's own compression; a row is a *segment*: some whole documents' ids, joined.
The ids of a segment are cut into blocks of a fixed number of ids; each block is transposed, either into byte planes
(all low bytes, then all second bytes ...) or into bit planes, and each plane is compressed with zstandard by itself.
High planes hold little and shrink to almost nothing. A plane of zeros only is stored as no bytes. The segment's chunk
index lists each block's number of ids and each plane's length, so any block can be read alone.

Segments carry (shard, segment); shard s holds the s-th range of doc_id and segments ascend within it.

Defined results: null text is an empty document (its end id only); rows that repeat a doc_id stay, next to each other, in
the order of a hash of their texts; null doc_ids sort first, in the same order, and may fill several shards; an empty table gives a file without segments; other columns are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claraudit.llm.common import forget, groups_for, release, stage_path
from claraudit.llm.tokens import SLICE_BYTES, encoder, vocabulary, with_end
from claraudit.llm.words import Texts

BLOCK_IDS, LEVEL, END_ID = 1 << 16, 3, 1
#: Text bytes that a task encodes and writes to one file, about.
TASK_BYTES = 128 << 20
#: What a worker remembers of encoded words: common ones are encoded again only when that is full.
REMEMBERED_BYTES = 64 << 20
SEGMENT = "shard int, segment int, n_ids long, doc_ids array<long>, doc_lengths array<int>, planes string, block_ids array<int>, plane_bytes array<int>, payload binary"
DOCUMENT = "shard int, segment int, place int, doc_id long, at long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """One block as 4 byte planes or 32 bit planes, lowest first; a plane of zeros as b''."""
    if planes == "byte":
        rows = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    else:
        rows = np.packbits(np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").T, axis=1, bitorder="little")
    return [x.tobytes() if x.any() else b"" for x in rows]


def from_planes(parts: list[bytes], n: int, planes: str) -> np.ndarray:
    """The inverse of to_planes."""
    if planes == "byte":
        out = np.zeros((n, 4), np.uint8)
        for i, x in enumerate(parts):
            if x:
                out[:, i] = np.frombuffer(x, np.uint8)
        return out.reshape(-1).view("<u4")
    bits = np.zeros((n, 32), np.uint8)
    for i, x in enumerate(parts):
        if x:
            bits[:, i] = np.unpackbits(np.frombuffer(x, np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


def pack_segment(ids: np.ndarray, planes: str, block_ids: int, level: int) -> tuple[list[int], list[int], bytes]:
    """(ids of each block, bytes of each plane, payload)."""
    import zstandard

    press, sizes, lengths, out = zstandard.ZstdCompressor(level=level), [], [], []
    for i in range(0, len(ids), block_ids):
        block = ids[i : i + block_ids]
        sizes.append(len(block))
        for x in to_planes(block, planes):
            out.append(press.compress(x) if x else b"")
            lengths.append(len(out[-1]))
    return sizes, lengths, b"".join(out)


def unpack_segment(sizes: list[int], lengths: list[int], payload: bytes, planes: str) -> np.ndarray:
    """All ids of a segment, block by block."""
    import zstandard

    press, width, at, parts = zstandard.ZstdDecompressor(), 4 if planes == "byte" else 32, 0, []
    for b, n in enumerate(sizes):
        block = []
        for m in lengths[b * width : (b + 1) * width]:
            block.append(press.decompress(payload[at : at + m]) if m else b"")
            at += m
        parts.append(from_planes(block, n, planes))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def write_tokens(docs: DataFrame, path: str, *, tokenizer: str | None = None, splits: str = "words", end_id: int = END_ID, planes: str = "byte", block_ids: int = BLOCK_IDS, level: int = LEVEL) -> None:
    """Encode the whole text of each document, append end_id and write segments, in ascending doc_id order."""
    spark, vocab = docs.sparkSession, tokenizer or vocabulary("word_bpe_49k.json")
    total = docs.agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 16)).first()[0] or 0

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard, k = encoder(vocab, splits, REMEMBERED_BYTES), TaskContext.get().partitionId(), 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, part in Texts.of(batch.column(1)).parts(SLICE_BYTES):
                ids, bounds = with_end(*enc.encode(part), end_id)
                sizes, lengths, payload = pack_segment(ids, planes, block_ids, level)
                row = [shard, k, len(ids), names[a : a + len(part)], np.diff(bounds).astype(np.int32), planes, sizes, lengths, payload]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [x.split()[0] for x in SEGMENT.split(", ")])
                k += 1
                release()
        release(0)

    (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange(groups_for(spark, total, TASK_BYTES, 2), "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
        .mapInArrow(encode, SEGMENT)
        .write.option("compression", "none")
        .parquet(path)
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the file: shard, segment, place, doc_id, at (ids before it in its segment), n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack_segment(r["block_ids"], r["plane_bytes"], r["payload"], r["planes"]).astype("<u4", copy=False)
                lengths = np.array(r["doc_lengths"], np.int64)
                ends, raw, n = np.cumsum(lengths), memoryview(ids.tobytes()), len(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, r["shard"], np.int32)), pa.array(np.full(n, r["segment"], np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(r["doc_ids"], pa.int64()), pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())],
                    [x.split()[0] for x in DOCUMENT.split(", ")],
                )

    return spark.read.schema(SEGMENT).parquet(path).mapInArrow(decode, DOCUMENT)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and its ids (array<long>), for consumers that train on them."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = unpack_segment(r["block_ids"], r["plane_bytes"], r["payload"], r["planes"]).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(r["doc_lengths"])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))], ["doc_id", "ids"])

    return spark.read.schema(SEGMENT).parquet(path).mapInArrow(decode, "doc_id long, ids array<long>")


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """The ids before each segment: a prefix sum over shards, then one within each shard. Reads no payload."""
    seg = spark.read.schema(SEGMENT).parquet(path).select("shard", "segment", "n_ids")
    shards = seg.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))  # a row a shard
    inside = Window.partitionBy("shard").orderBy("segment")
    return seg.withColumn("inner", F.sum("n_ids").over(inside) - F.col("n_ids")).join(before, "shard").select("shard", "segment", (F.col("shard_start") + F.col("inner")).alias("segment_start"))


def op9_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return (
        read_documents(spark, path)
        .join(segment_starts(spark, path), ["shard", "segment"])
        .select("doc_id", (F.col("segment_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
    )


QUERIES = {"op9_bit_planes": op9_bit_planes}
SQL: dict[str, str] = {}
