"""Token counts from flat token files by a separator scan (operator 1).

A flat file is a bare sequence of fixed-width ids in which one id ends each document; there is no index. The scan cuts
a file into blocks of a fixed number of ids and searches each block for the separator by one vectorised comparison. A
block gives the lengths that begin and end inside it, and what stands before its first and behind its last separator.
A prefix scan over a file's blocks then carries the open lengths and the numbers of documents across block boundaries,
however many blocks a document spans. Files of one stream (by default those of one folder, in name order) are scanned as
one sequence: sums of whole files are carried over first, so a document may begin in one file, which one task reads, and
end in another.

write_flat() makes such files from documents: id + 1 of the vocabulary as little-endian numbers of 16 bits (or 32, by
dtype; ids that don't fit raise), and 0 ends a document. A file is written by one task in its row order; the doc_ids of
its documents, in that order, go to a names table beside it, only to name what the scan counts. Spark reads a file as one
row, so a file has 2 GB at most; a longer stream is several files.

Defined results: null or empty text is a document of no tokens; ids behind a stream's last separator are a document that
isn't terminated; an empty file has no documents; repeated rows and null doc_ids stay; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claraudit.llm.common import forget, release, stage_path, staged
from claraudit.llm.tokens import SLICE_BYTES, encoder, vocabulary, with_end
from claraudit.llm.words import Texts

#: Ids of a block, and about how many a file gets.
BLOCK, FILE_IDS = 1 << 18, 3 << 20
COUNTS = "file string, block int, n_ids long, n_ends int, head long, tail long, inner array<int>"


def write_flat(docs: DataFrame, path: str, *, tokenizer: str | None = None, splits: str = "words", file_ids: int = FILE_IDS, dtype: str = "<u2") -> None:
    """`path`/kind=ids/file=F/... are the flat files, `path`/kind=names/file=F/... the doc_ids. No shuffle."""
    vocab, most = tokenizer or vocabulary("word_bpe_49k.json"), np.iinfo(dtype).max

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task, file, used, k = encoder(vocab, splits), TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, part in Texts.of(batch.column(1)).parts(SLICE_BYTES):
                ids, bounds = enc.encode(part)
                if len(ids) and int(ids.max()) >= most:
                    raise ValueError(f"id {ids.max()} doesn't fit {dtype}")
                flat = with_end(ids + 1, bounds, 0)[0].astype(dtype)[:-1]  # the writer ends each row with a separator
                if used > file_ids:
                    file, used = file + 1, 0
                used += len(flat)
                name = f"{task:06d}-{file:04d}"
                listed = f"{k}:" + ",".join("" if x is None else str(x) for x in names[a : a + len(part)])
                yield pa.RecordBatch.from_arrays([pa.array(["ids", "names"]), pa.array([name] * 2), pa.array([k] * 2, pa.int32()), pa.array([flat.tobytes(), listed.encode()], pa.binary())], ["kind", "file", "k", "value"])
                k += 1
                release()
        release(0)

    (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(encode, "kind string, file string, k int, value binary")
        .sortWithinPartitions("kind", "file", "k")
        .select("kind", "file", F.col("value").cast("string").alias("value"))
        .write.partitionBy("kind", "file")
        .option("lineSep", "\x00" * np.dtype(dtype).itemsize)
        .text(path)
    )


def block_counts(spark: SparkSession, path: str, *, separator: int = 0, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """What each block of each flat file under `path` shows by itself."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids, rows = np.frombuffer(content.as_buffer(), dtype), []
                for b, a in enumerate(range(0, len(ids), block)):
                    ends = np.flatnonzero(ids[a : a + block] == separator)
                    n = min(block, len(ids) - a)
                    head, tail = (int(ends[0]), n - 1 - int(ends[-1])) if len(ends) else (n, n)
                    rows.append((name, b, n, len(ends), head, tail, (np.diff(ends) - 1).tolist()))
                if rows:
                    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in COUNTS.split(", ")])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(scan, COUNTS)


def separator_scan(spark: SparkSession, path: str, *, stream: Column | None = None, **how) -> DataFrame:
    """A row for each document: stream, ordinal (from 0), start (ids and separators before it in its stream), n_tokens,
    terminated. stream: what a file's path, column `file`, says about its stream."""
    stream = F.regexp_extract("file", "^(.*)/[^/]*$", 1) if stream is None else stream
    b = staged(block_counts(spark, path, **how).withColumn("stream", stream), "blocks")
    ends = F.when(F.col("n_ends") > 0, F.col("at") + F.col("n_ids") - F.col("tail"))
    # whole files first: the ids and ends before each, and where the document that reaches into it begins
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("at", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn("docs_before", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    b = b.withColumn("open", F.max(ends).over(before))
    earlier = Window.partitionBy("stream").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = b.groupBy("stream", "file").agg(F.sum("n_ids").alias("ids"), F.sum("n_ends").alias("docs"), F.max(ends).alias("last_end"))  # a row a file
    files = files.select("stream", "file", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("file_at"), F.coalesce(F.sum("docs").over(earlier), F.lit(0)).alias("file_docs"), "last_end", "docs", (F.lead("file").over(Window.partitionBy("stream").orderBy("file"))).isNull().alias("last_file"))
    files = files.withColumn("file_open", F.coalesce(F.max(F.col("file_at") + F.col("last_end")).over(earlier), F.lit(0))).drop("last_end", "docs")
    b = b.join(files, ["stream", "file"])
    b = b.withColumn("open", F.coalesce(F.col("file_at") + F.col("open"), "file_open")).withColumn("at", F.col("file_at") + F.col("at")).withColumn("docs_before", F.col("file_docs") + F.col("docs_before"))
    last = F.col("last_file") & (F.col("block") == F.max("block").over(Window.partitionBy("file")))
    opening = F.when(F.col("n_ends") > 0, F.array(F.col("at") + F.col("head") - F.col("open"))).otherwise(F.array().cast("array<long>"))
    b = b.select("stream", "docs_before", "n_ends", "at", "open", "head", "tail", "n_ids", last.alias("last"), F.concat(opening, F.col("inner").cast("array<long>")).alias("lengths"))
    ended = b.select("*", F.posexplode("lengths").alias("i", "n_tokens")).drop("lengths")
    inside = Window.partitionBy("stream", "docs_before", "at").orderBy("i")
    ended = ended.withColumn("start", F.col("open") + F.sum(F.col("n_tokens") + 1).over(inside) - F.col("n_tokens") - 1)
    ended = ended.select("stream", (F.col("docs_before") + F.col("i")).alias("ordinal"), "start", "n_tokens", F.lit(True).alias("terminated"))
    start = F.when(F.col("n_ends") > 0, F.col("at") + F.col("n_ids") - F.col("tail")).otherwise(F.col("open"))
    rest = b.filter("last").select("stream", (F.col("docs_before") + F.col("n_ends")).alias("ordinal"), start.alias("start"), (F.col("at") + F.col("n_ids") - start).alias("n_tokens"), F.lit(False).alias("terminated"))
    return ended.unionByName(rest.filter("n_tokens > 0"))


def document_names(spark: SparkSession, path: str, *, dtype: str = "<u2") -> DataFrame:
    """file, ordinal and doc_id of what write_flat() wrote."""
    lines = spark.read.option("lineSep", "\x00" * np.dtype(dtype).itemsize).text(path).select(F.regexp_extract("_metadata.file_path", "file=([^/]*)/", 1).alias("file"), F.split("value", ":", 2).alias("v"))
    lines = lines.select("file", F.col("v")[0].cast("int").alias("k"), F.split(F.col("v")[1], ",").alias("ids"))
    before = Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("before", F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)))
    return lines.select("file", "before", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("before") + F.col("i")).alias("ordinal"), F.expr("try_cast(doc_id as bigint)").alias("doc_id"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = stage_path(spark, "flat")
    write_flat(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    found = separator_scan(spark, f"{path}/kind=ids", stream=F.regexp_extract("file", "file=([^/]*)/", 1)).withColumnRenamed("stream", "file")
    return found.join(document_names(spark, f"{path}/kind=names"), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens", "terminated")


QUERIES = {"op1_token_counts": op1_token_counts}
SQL: dict[str, str] = {}
