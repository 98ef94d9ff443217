"""A corpus pipeline of five stages over `documents`: language identification, near-duplicate removal, substring dedup,
mixing and packing. All but the last return the columns of documents; each one's decisions are in the rows, texts or row
order that it returns; the order is that of the rows in the files between two stages, and packing keeps it.

Defined results: rows repeating (doc_id, text) are one document behind the near-duplicate stage, so are rows of one text
without a doc_id; texts without a word aren't copies of anything; a document of which nothing is left after substring
dedup goes; empty in, empty out.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claraudit.llm.common import file_order, staged
from claraudit.llm.fingerprint_index import dedup_substrings
from claraudit.llm.language_id import identify
from claraudit.llm.minhash_join import jaccard_groups, text_digest
from claraudit.llm.mixing import in_order, mix
from claraudit.llm.packing import pack_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_REST = ("lang", "source", "n_chars")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models don't reject."""
    return identify(docs, keep=_REST).filter("not rejected").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document, that of the smallest doc_id; of rows that repeat (doc_id, text) one."""
    docs = docs.select(*COLUMNS)
    kept = jaccard_groups(docs).filter("kept").select("doc_id", "digest").distinct()
    rows, kept = docs.withColumn("_digest", text_digest()).alias("d"), kept.alias("k")
    rows = rows.join(kept, F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d._digest") == F.col("k.digest")), "left_semi")
    blank = F.col("text").isNull() | (F.trim(F.regexp_replace("text", "[\\x09-\\x0D]", " ")) == "")
    rows = rows.withColumn("_own", F.when(blank, F.monotonically_increasing_id()))
    return rows.dropDuplicates(["doc_id", "_digest", "_own"]).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; texts that lose nothing stay as they are."""
    cut = dedup_substrings(docs, keep=_REST, original=True).filter("n_words = 0 or n_removed < n_words")
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mix over files and within each; packing follows that order."""
    return in_order(mix(docs.select(*COLUMNS))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its sequence and place. Pieces are packed in ranges of the order in which the documents lie
    in their files, and sequences are numbered by it, so neighbouring sequences hold the sources in the mix's shares."""
    try:
        ordered = file_order(docs.select(*COLUMNS))
    except AnalysisException:  # rows that weren't written to files lie in no order
        return pack_documents(docs)
    return pack_documents(ordered, order="_order")


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]
#: MinHash, language models and tokenisers aren't SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs
