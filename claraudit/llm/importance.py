"""Importance resampling towards a target's word distribution with partition-local word tries (operator 11).

Features are all runs of `shortest` to `longest` consecutive words, joined by one space. A task keeps a trie whose edges
are words: a node stands for the run on its path and holds its count and the state of its CRC-32, which a child's goes on
from, so a run is never spelt out. The node's bucket is that checksum modulo `buckets`. First tries count: a task hands on
one total for each bucket, Spark adds up those of the documents and of the target. From the totals (bounded by `buckets`)
each bucket has a gain, the rounded log ratio of its smoothed target and corpus shares. Then tries score: gains are attached
to nodes as they are made, and a document's weight is the floored mean of the gains on its paths.

Drawing: Gumbel noise from a hash of `seed` and doc_id is added to weights, and the given percentage of the documents with
at least `min_words` words is drawn by highest score. Scores are whole numbers, so a count for each score (their number is
bounded by the range of gains and noise) gives the cut and each score's first rank; documents are ranked only among those
of the same score. No global sort, and undrawn documents aren't shuffled.

A trie that outgrows `TRIE_BYTES` is begun anew (its counts are handed on first), which changes no result.

Defined results: a null text has no words; a document without features has weight 0; a null doc_id hashes as an empty one
and comes behind others of its score; repeated rows are ranked one after the other; an empty target gives every bucket
a count of 0; an empty table gives no rows. Columns named in `keep` are carried along, others never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claraudit.llm.common import forget, release, staged
from claraudit.llm.terms import WORDS, lower_ascii, remember, runs
from claraudit.llm.words import Remembered, Texts

BUCKETS, PERCENT, MIN_WORDS, SEED = 10_000, 10, 20, 2024
SLICE, TRIE_BYTES = 2 << 20, 96 << 20


class _Level:
    """Nodes of one depth: (parent, word) -> number, by a sorted array; their CRC states and values."""

    def __init__(self):
        self.keys, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.crc, self.value = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def children(self, keys: np.ndarray, crc_of) -> tuple[np.ndarray, np.ndarray]:
        """(number of each key's node, numbers of those made now)."""
        uniq, inverse = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.keys, uniq)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == uniq[there]
        new = uniq[~there]
        made = len(self.crc) + np.arange(len(new))
        out = np.empty(len(uniq), np.int64)
        out[there], out[~there] = self.ids[at[there]], made
        if len(new):
            self.keys, self.ids = np.insert(self.keys, at[~there], new), np.insert(self.ids, at[~there], made)
            self.crc, self.value = np.concatenate([self.crc, crc_of(new)]), np.concatenate([self.value, np.zeros(len(new), np.int64)])
        return out[inverse], made


class WordTrie:
    """gains: of each bucket, attached to nodes as they are made; without them nodes count."""

    def __init__(self, longest: int, buckets: int, gains: np.ndarray | None = None):
        self.longest, self.buckets, self.gains = longest, buckets, gains
        self.clear()

    def clear(self) -> None:
        self.words, self.levels = Remembered(), [_Level() for _ in range(self.longest)]

    def bytes(self) -> int:
        return self.words.bytes() + sum(32 * len(x.crc) for x in self.levels)

    def paths(self, t: Texts) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, node, row) of all runs of each length, and the number of words of each row."""
        p = runs(t, WORDS)
        code, known = remember(self.words, p)
        word, row, n_words = known[code], p.row_of(), p.counts()
        node, at = np.zeros(len(word), np.int64), np.arange(len(word))  # of the run that begins at each word
        for depth, level in enumerate(self.levels):
            # a run goes on by the word behind it, if that's in the same row
            at = at[at < len(row) - depth]
            at = at[row[at] == row[at + depth]]
            found, made = level.children(node[at] << 32 | word[at + depth], lambda keys, d=depth: self._states(d, keys))
            node[at] = found
            if self.gains is not None and len(made):
                level.value[made] = self.gains[level.crc[made] % self.buckets]
            yield depth + 1, found, row[at], n_words

    def _states(self, depth: int, keys: np.ndarray) -> np.ndarray:
        w = self.words
        raw, parents = w.data, self.levels[depth - 1].crc if depth else None
        out = np.empty(len(keys), np.int64)
        for i, key in enumerate(keys.tolist()):  # once for each node
            word = key & 0xFFFFFFFF
            piece = raw[w.starts[word] : w.starts[word] + w.lengths[word]]
            out[i] = zlib.crc32(piece, zlib.crc32(b" ", int(parents[key >> 32]))) if depth else zlib.crc32(piece)
        return out

    def totals(self, shortest: int) -> np.ndarray:
        """The counts of each bucket."""
        out = np.zeros(self.buckets, np.int64)
        for level in self.levels[shortest - 1 :]:
            np.add.at(out, level.crc % self.buckets, level.value)
        return out


def bucket_totals(texts: DataFrame, shortest: int, longest: int, buckets: int) -> DataFrame:
    """bucket, n: feature occurrences of all texts, by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        trie, sums = WordTrie(longest, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in Texts.of(batch.column(0)).parts(SLICE):
                for length, node, _, _ in trie.paths(lower_ascii(part)):
                    if length >= shortest:
                        level = trie.levels[length - 1]
                        level.value += np.bincount(node, minlength=len(level.crc))
                if trie.bytes() > TRIE_BYTES:
                    sums += trie.totals(shortest)
                    trie.clear()
                release()
        sums += trie.totals(shortest)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])
        release(0)

    counted = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))) of each of B buckets."""
    b, s, t = len(corpus), corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (float(corpus.sum()) + b) / ((s + 1) * (float(target.sum()) + b)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, shortest: int, longest: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_features, weight and the columns of `keep`."""
    fields = [F.col("doc_id").cast("long").alias("_doc"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]]
    base = docs.select(*fields, F.col("text").cast("string").alias("_text"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        trie = WordTrie(longest, len(gain), gain)
        for batch in batches:
            last = batch.num_columns - 1
            for a, part in Texts.of(batch.column(last)).parts(SLICE):
                rows, n, total, words = len(part), np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), None
                for length, node, row, words in trie.paths(lower_ascii(part)):
                    if length >= shortest:
                        n += np.bincount(row, minlength=rows)
                        np.add.at(total, row, trie.levels[length - 1].value[node])
                columns = [batch.column(i).slice(a, rows) for i in range(last)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(words), pa.array(n), pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))], [*batch.schema.names[:last], "_words", "_features", "_weight"])
                if trie.bytes() > TRIE_BYTES:
                    trie.clear()
                release()
        release(0)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.drop("_text").schema.fields)
    out = base.mapInArrow(walk, f"{schema}, _words long, _features long, _weight long")
    kept = [F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(F.col("_doc").alias("doc_id"), *kept, F.col("_words").alias("n_words"), F.col("_features").alias("n_features"), F.col("_weight").alias("weight"))


def ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """Adds rank (from 1, null: not drawn) to a table with doc_id, n_words and score, which is read three times."""
    fit = F.col("n_words") >= min_words
    by_score = scored.filter(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # as many rows as scores; their number doesn't grow with the documents
    above = Window.orderBy(F.desc("score"))
    by_score = staged(by_score.withColumn("before", F.sum("n").over(above) - F.col("n")), "scores")
    all_n = by_score.agg(F.sum("n")).first()[0] or 0
    quota = percent * all_n // 100
    cut = by_score.filter(F.col("before") < quota).agg(F.min("score")).first()[0]
    drawn = F.lit(False) if cut is None else F.coalesce(fit & (F.col("score") >= cut), F.lit(False))
    rest = scored.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))
    inside = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"))
    some = scored.filter(drawn).withColumn("_at", F.row_number().over(inside)).join(by_score.select("score", "before"), "score")
    place = F.col("before") + F.col("_at")
    some = some.withColumn("rank", F.when(place <= quota, place).cast("long"))
    return rest.unionByName(some.select(*rest.columns))


def resample(docs: DataFrame, target: DataFrame, *, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep`, n_words, n_features, weight, score, rank (null: not drawn). target: a table with text."""
    totals = [np.zeros(buckets, np.int64) for _ in range(2)]
    for sums, texts in zip(totals, (docs, target), strict=True):
        for r in bucket_totals(texts, shortest, longest, buckets).collect():  # `buckets` rows at most
            sums[r["bucket"]] = r["n"]
    scored = weights(docs, gains(*totals), shortest, longest, keep)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return ranked(staged(scored.withColumn("score", F.col("weight") + noise), "weights"), percent, min_words)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op11_importance_resampling": op11_importance_resampling}
#: The checksum's table by the polynomial's rule, bytes by their hexadecimal digits.
SQL = {
    "op11_importance_resampling": r"""
WITH RECURSIVE z(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM z WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM z WHERE k = 8),
d AS (SELECT row_number() OVER () AS id, doc_id, text FROM documents),
w AS (
  SELECT 0 AS side, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM d
  UNION ALL
  SELECT 1, 0, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
v AS (SELECT DISTINCT word FROM w),
x AS (SELECT word, hex(encode(word)) AS h FROM v),
y AS (
  SELECT word, CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(h) // 2 AS BIGINT)), lambda i: CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS BIGINT) AS bucket
  FROM x, tab),
c AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM w JOIN y USING (word) GROUP BY bucket),
a AS (SELECT CAST(sum(s) AS DOUBLE) AS ss, CAST(sum(t) AS DOUBLE) AS tt FROM c),
g AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000)))) AS BIGINT) AS gain FROM c, a),
f AS (SELECT id, count(*) AS n, sum(gain) AS gain FROM w JOIN y USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY id),
o AS (
  SELECT d.id, doc_id, coalesce(n, 0) AS n_features, CAST(coalesce(floor(CAST(gain AS DOUBLE) / n), 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN f ON f.id = d.id),
q AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM o),
r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place, count(*) FILTER (n_features >= 20) OVER () AS fit FROM q)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN place <= 10 * fit // 100 THEN place END AS rank FROM r
"""
}
