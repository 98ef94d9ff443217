"""Exact top-k search over binary codes by incremental multi-index hashing (operator 10).

A vector's code is its number of components d and the signs of all of them, 64 to a long. Codes are cut into segments
over their d bits; the index has a row for each (d, segment, value, code). Two codes within distance m (r + 1) - 1 agree
on one of m segments up to r bits, so probing every value within r bits of a query's segments finds all codes up to that
distance: the covered distance. Rounds grow r from 0. A round keeps the codes at a covered distance only, each from the
first segment that shows it; a query leaves when its k-th distance is covered, and what is left goes on. Queries for
which probing would take more values than there are codes of their length are compared with all of these in blocks,
which is exact too: a task compares a block of queries with a block of codes and keeps each query's k nearest.

Vectors of equal codes are one index row that carries its k smallest ids: no result ever needs another.

Defined results: a vector that is null, empty, or holds a null or NaN component has no code: it is no result and gets
none. A query isn't its own result, its copies are (distance 0). Ties go to the smaller id. Fewer than k other vectors
give fewer rows. Repeated rows count once for each id. Vectors of another length only meet their like: each length has
segments of its own. An empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claraudit.llm.common import bucket, staged

#: Codes of up to UNROLLED longs are compared by an expression for each, longer ones in a loop.
K, QUERY_STEP, UNROLLED = 10, 20, 16
#: Queries and codes of a block of the scan, about.
QUERY_BLOCK, CODE_BLOCK = 512, 8192


def sign_code(vector: Column) -> Column:
    """(d, words): bit i % 64 of word i // 64 is set where component i is above 0."""
    zero = F.lit(0).cast("long")

    def word(w: Column) -> Column:
        bits = F.transform(F.slice(vector, w * 64 + 1, 64), lambda x, i: F.when(x > 0, _left(F.lit(1).cast("long"), i)).otherwise(zero))
        return F.aggregate(bits, zero, lambda s, x: s.bitwiseOR(x))

    words = F.transform(F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / 64).cast("int")), word)
    good = (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return F.when(F.coalesce(good, F.lit(False)), F.struct(F.size(vector).alias("d"), words.alias("words")))


def segments_for(d: Column, n_codes: Column) -> Column:
    """Segments of at most log2(codes) bits: a probe then meets a code at least, on average, and few probes miss."""
    return F.ceil(d / F.greatest(F.lit(4.0), F.log2(F.greatest(F.lit(2), n_codes)))).cast("int")


def _left(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits.cast("int"))


def _cut(d: Column, m: Column, seg: Column) -> tuple[Column, Column]:
    """(shift, bits) of a segment of d bits in m segments."""
    edge = lambda i: F.floor(i.cast("long") * d / m).cast("int")
    return edge(seg), edge(seg + 1) - edge(seg)


def _part(word: Callable[[Column], Column], shift: Column, bits: Column) -> Column:
    """Up to 63 bits of a code from bit `shift` on; they may lie in two words."""
    at, off = F.floor(shift / 64).cast("int"), (shift % 64).cast("int")
    low = F.call_function("shiftrightunsigned", word(at), off)
    high = F.when(off + bits > 64, _left(word(at + 1), 64 - off)).otherwise(F.lit(0).cast("long"))
    return low.bitwiseOR(high).bitwiseAND(_left(F.lit(1).cast("long"), bits) - 1)


def _words(code: str) -> Callable[[Column], Column]:
    return lambda i: F.get(F.col(f"{code}.words"), i)


def _distance(a: str, b: str, words: int) -> Column:
    """Of two codes of one length; words: the longest code's."""
    if words <= UNROLLED:
        parts = [F.coalesce(F.bit_count(_words(a)(F.lit(i)).bitwiseXOR(_words(b)(F.lit(i)))), F.lit(0)) for i in range(words)]
        return reduce(lambda x, y: x + y, parts, F.lit(0))
    differing = F.zip_with(f"{a}.words", f"{b}.words", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(differing, F.lit(0), lambda s, x: s + x)


def _near(radius: int) -> Callable[[Column], Column]:
    """Whether q_code and code agree on a segment up to `radius` bits."""

    def differing(i: Column) -> Column:
        return _words("q_code")(i).bitwiseXOR(_words("code")(i))

    return lambda seg: F.bit_count(_part(differing, *_cut(F.col("q_code.d"), F.col("m"), seg))) <= radius


def _probes(queries: DataFrame, radius: int) -> DataFrame:
    """Each value within `radius` bits of a segment's: flipped bits are chosen in descending order, -1 ends the choice."""
    out = queries.withColumn("seg", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    shift, bits = _cut(F.col("q_code.d"), F.col("m"), F.col("seg"))
    out = out.withColumn("value", _part(_words("q_code"), shift, bits)).withColumn("_top", bits)
    for _ in range(radius):
        out = out.withColumn("_flip", F.explode(F.sequence(F.lit(-1), F.col("_top") - 1)))
        flipped = F.col("value").bitwiseXOR(_left(F.lit(1).cast("long"), F.col("_flip")))
        out = out.withColumn("value", F.when(F.col("_flip") < 0, F.col("value")).otherwise(flipped)).withColumn("_top", F.greatest("_flip", F.lit(0)))
    return out.select("q_code", "m", F.col("q_code.d").alias("d"), "seg", "value")


def _affordable(radius: int) -> Column:
    """Whether probing up to `radius` takes at most as many values as there are codes."""
    each = F.array(*[F.lit(float(sum(comb(w, r) for r in range(radius + 1)))) for w in range(64)])
    return (F.col("widest") >= radius) & (F.get(each, F.col("widest")) * F.col("m") <= F.greatest(F.col("n"), F.lit(64)))


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest (distance, id) of each query from (q_code, distance, ids)."""
    pairs = found.select("q_code", "distance", F.explode("ids").alias("id"))
    order = Window.partitionBy("q_code").orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hamming_top_k(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", queries: Column | None = None, k: int = K, segments: int | None = None) -> DataFrame:
    """query_id, rank (from 1), id, distance: the exact k nearest other vectors of each query row, by default those whose
    id is divisible by 20."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), sign_code(F.col(vector_col)).alias("code")).filter("id is not null and code is not null")
    rows = staged(rows, "codes")
    wanted = rows.filter(F.col("id") % QUERY_STEP == 0 if queries is None else queries).distinct()
    # pre-aggregated by a salt, then by code: a code that holds a third of all rows is no hot task
    some = F.slice(F.array_sort(F.collect_set("id")), 1, k + 1)
    salted = rows.withColumn("salt", bucket(64, "id")).groupBy("code", "salt", F.floor(F.col("id") / 512).alias("run")).agg(some.alias("ids"))
    codes = salted.groupBy("code", "salt").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    codes = staged(codes.groupBy("code").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids")), "code-ids")
    # one row for each length of vectors
    lengths = codes.groupBy(F.col("code.d").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    m = segments_for(F.col("d"), F.col("n")) if segments is None else F.least(F.col("d"), F.greatest(F.lit(segments), F.ceil(F.col("d") / 62)))
    lengths = staged(lengths.withColumn("m", m.cast("int")).withColumn("widest", F.ceil(F.col("d") / F.col("m")).cast("int")), "lengths")
    words = -(-(lengths.agg(F.max("d")).first()[0] or 0) // 64)
    shift, bits = _cut(F.col("d"), F.col("m"), F.col("seg"))
    index = codes.withColumn("d", F.col("code.d")).join(F.broadcast(lengths), "d").withColumn("seg", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    index = staged(index.select("d", "seg", _part(_words("code"), shift, bits).alias("value"), "code", "ids"), "segments")
    left = wanted.select(F.col("code").alias("q_code")).distinct().withColumn("d", F.col("q_code.d")).join(F.broadcast(lengths), "d").drop("d")
    left = staged(left, "left")
    done = []
    radius, distance = 0, _distance("q_code", "code", words)
    while not (now := left.filter(_affordable(radius))).isEmpty():
        covered = F.col("m") * (radius + 1) - 1
        # the first segment within the radius shows the code
        here = (F.col("p.seg") == 0) | ~F.exists(F.sequence(F.lit(0), F.greatest(F.col("p.seg") - 1, F.lit(0))), _near(radius))
        same = (F.col("p.d") == F.col("i.d")) & (F.col("p.seg") == F.col("i.seg")) & (F.col("p.value") == F.col("i.value"))
        found = _probes(now, radius).alias("p").join(index.hint("merge").alias("i"), same & (distance <= covered) & here)
        # k + 1: a query's own id is among them
        top = staged(_top(found.select("q_code", distance.alias("distance"), "ids"), k + 1).select("q_code", "distance", "id", "rank"), "nearest")
        full = top.groupBy("q_code").agg(F.max("rank").alias("n")).filter(F.col("n") >= k + 1).select("q_code")
        done.append(top.join(full, "q_code", "left_semi").select("q_code", "distance", "id"))
        left = staged(left.join(full, "q_code", "left_anti"), "left")
        radius += 1
    if not done or not left.isEmpty():
        done.append(_scan(left.select("q_code"), codes, lengths, k + 1))
    answers = done[0]
    for x in done[1:]:
        answers = answers.unionByName(x)
    out = wanted.select(F.col("id").alias("query_id"), F.col("code").alias("q_code")).join(answers, "q_code").filter("id <> query_id")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _block_top(k: int):
    """The k nearest (distance, id) of each query of a block over the codes of another: queries (d, words), codes (words, ids)."""

    def run(queries: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        out = {"d": [], "words": [], "distance": [], "id": []}
        if len(queries) and len(codes):
            q, c = (np.stack(x["words"].to_numpy()).astype(np.int64).view(np.uint64) for x in (queries, codes))
            lists, few = codes["ids"].to_numpy(), min(k, len(c))
            step = max(1, (1 << 22) // len(c))
            for lo in range(0, len(q), step):
                apart = np.zeros((len(q[lo : lo + step]), len(c)), np.int32)
                for w in range(q.shape[1]):
                    apart += np.bitwise_count(q[lo : lo + step, w, None] ^ c[None, :, w])
                # every code has an id at least: none beyond the k-th nearest code is needed
                most = np.partition(apart, few - 1, axis=1)[:, few - 1]
                for i, row in enumerate(apart):
                    near = np.flatnonzero(row <= most[i])
                    ids = np.concatenate([lists[j] for j in near])
                    far = np.repeat(row[near], [len(lists[j]) for j in near])
                    best = np.lexsort((ids, far))[:k]
                    out["d"] += [queries["d"].iloc[0]] * len(best)
                    out["words"] += [queries["words"].iloc[lo + i]] * len(best)
                    out["distance"] += far[best].tolist()
                    out["id"] += ids[best].tolist()
        return pd.DataFrame(out)

    return run


def _scan(left: DataFrame, codes: DataFrame, lengths: DataFrame, k: int) -> DataFrame:
    """q_code, distance, id: the k nearest of the queries left over all codes of their length. Blocks of both, by numbers of
    rows, meet once each in a task that gives only its k nearest of each query: k rows a query and block are shuffled."""
    asked = left.groupBy(F.col("q_code.d").alias("d")).agg(F.count(F.lit(1)).alias("asked"))  # a row a length
    sizes = F.broadcast(asked.join(lengths, "d").select("d", F.ceil(F.col("asked") / QUERY_BLOCK).alias("qbs"), F.ceil(F.col("n") / CODE_BLOCK).alias("cbs")))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    q = left.select(F.col("q_code.d").alias("d"), F.col("q_code.words").alias("words")).join(sizes, "d")
    q = q.withColumn("qb", part("words", "qbs")).select("d", "qb", every("cbs").alias("cb"), "words")
    c = codes.select(F.col("code.d").alias("d"), F.col("code.words").alias("words"), "ids").join(sizes, "d")
    c = c.withColumn("cb", part("words", "cbs")).select("d", every("qbs").alias("qb"), "cb", "words", "ids")
    by = ["d", "qb", "cb"]
    met = q.groupBy(*by).cogroup(c.groupBy(*by)).applyInPandas(_block_top(k), "d int, words array<long>, distance int, id long")
    order = Window.partitionBy("d", "words").orderBy("distance", "id")
    best = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select(F.struct("d", "words").alias("q_code"), "distance", "id")


def op10_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


QUERIES = {"op10_hamming_top_k": op10_hamming_top_k}
SQL = {
    "op10_hamming_top_k": """
WITH c AS (
  SELECT vec_id AS id, bits FROM (
    SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END) AS b, array_to_string(b, '') AS bits
    FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0)),
d AS (
  SELECT q.id AS query_id, c.id AS id, CAST(hamming(q.bits, c.bits) AS INTEGER) AS distance
  FROM c q JOIN c ON q.id % 20 = 0 AND q.id <> c.id)
SELECT query_id, rank, id, distance FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM d)
WHERE rank <= 10
"""
}
