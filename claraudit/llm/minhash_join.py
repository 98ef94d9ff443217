"""N-gram Jaccard self-join by MinHash banding (operator 8).

A document's set is its distinct n-grams of consecutive words (runs of bytes other than white space, unchanged); a text
of fewer words is one n-gram of them all. Documents of one text are a class: its smallest doc_id stands for it and a
link to the class counts for each copy. Two documents are linked where their sets' Jaccard similarity reaches the
threshold.

1. A pass over all texts gives each document's SHA-256 and MinHash values, no text leaves its task.
2. Representatives are shuffled on (band, hash of the band's values); band and row counts are chosen for the target
   recall at the threshold. A bucket of a few gives pairs of ids, which stay only where the MinHash values of both agree
   almost as often as at the threshold; a larger bucket links its members to its smallest one, never pair by pair.
3. Components of these links are the *neighbourhoods*: what is to be verified together. Their texts are brought together
   once; a large neighbourhood is cut into blocks and each pair of blocks is a task of its own.
4. A task builds the full sets, whose n-grams are the same only if all their words' bytes are, and verifies all its pairs
   by sparse matrix products. It gives numbers of links and a spanning star for each found component, not pairs.

Defined results: null, empty or blank text has no n-grams and links with nothing, not even its like; rows repeating
(doc_id, text) are one document, but each row with a null doc_id is one of its own; different texts under one doc_id are
different documents. class_id and component_id are null where no document of theirs has an id. An empty table gives no
rows; other columns are never read. Ties don't matter: all outputs are smallest ids or counts. Numbers from OWN_IDS on
can't be doc_ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claraudit.llm.common import GROUP_BYTES, bucket, drop_path, forget, groups_for, release, stage_path, staged
from claraudit.llm.components import components, local_roots
from claraudit.llm.words import Texts, windows, words

NGRAM, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.9999, 192
#: Members of a bucket up to which it gives pairs; documents of a block of a large neighbourhood.
FEW, BLOCK = 24, 256
#: Documents that their doc_id doesn't name get numbers from here on, by text.
OWN_IDS = (1 << 63) - (1 << 61)
_U = np.uint64


@lru_cache
def bands_for(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band, hence the fewest false candidates, with which a pair at the threshold shares
    a band with probability `recall` at least."""
    for rows in range(hashes, 0, -1):
        bands = hashes // rows
        if 1 - (1 - threshold**rows) ** bands >= recall:
            return bands, rows
    return hashes, 1


@lru_cache
def _multipliers(hashes: int) -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 1 << 63, size=(hashes, 2), dtype=np.uint64) | _U(1)


def ngram_hashes(t: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's n-grams, with repeats, and the bounds of each row's."""
    w = words(t)
    h = w.hashes()
    grams, at = windows(h, w.first, n)
    first = np.searchsorted(at, w.first)
    short = np.flatnonzero((w.counts() > 0) & (w.counts() < n))
    if len(short):
        extra = np.array([windows(h[a:b], np.array([0, b - a]), b - a, seed=b - a)[0][0] for a, b in zip(w.first[short].tolist(), w.first[short + 1].tolist(), strict=True)], _U)
        grams = np.insert(grams, first[short], extra)
        first = first + np.searchsorted(short, np.arange(len(first)), "left")
    return grams, first


def exact_ngrams(t: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each row's n-grams, with repeats, and the bounds of each row's; equal where all words' bytes are."""
    w = words(t)
    code = w.exact_codes()[0].astype(np.int64)
    gram, count, start = code, w.counts(), w.first[:-1]
    short = []
    for k in range(1, n):
        rows = np.flatnonzero(count == k)
        short.append((rows, gram[start[rows]] * (n + 1) + k))
        gram = pd.factorize(gram[:-1] * (len(code) + 1) + code[k:])[0] if len(gram) else gram
    left = np.repeat(w.first[1:], count) - np.arange(len(code))
    at = np.flatnonzero(left[: len(gram)] >= n)
    rows = np.concatenate([np.searchsorted(w.first, at, "right") - 1, *[r for r, _ in short]])
    grams = np.concatenate([gram[at] * (n + 1) + n, *[g for _, g in short]])
    order = np.argsort(rows, kind="stable")
    return grams[order], np.searchsorted(rows[order], np.arange(len(t) + 1))


def minhash(grams: np.ndarray, first: np.ndarray, hashes: int) -> np.ndarray:
    """32-bit MinHash values (rows x hashes); rows without n-grams get zeros."""
    out = np.zeros((len(first) - 1, hashes), np.uint32)
    rows = np.flatnonzero(np.diff(first) > 0)
    if len(rows):
        starts = first[rows]
        for j, (a, b) in enumerate(_multipliers(hashes)):
            out[rows, j] = np.minimum.reduceat((grams ^ b) * a, starts) >> _U(32)
    return out


def _features(n: int, hashes: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            names, digests = batch.column(0), batch.column(1)
            for a, part in Texts.of(batch.column(2)).parts(1 << 20):
                k = len(part)
                grams, first = ngram_hashes(part, n)
                sig = minhash(grams, first, hashes)
                keys = np.zeros((k, bands), _U)
                for r in range(rows):
                    keys = (keys ^ sig[:, : bands * rows].reshape(k, bands, rows)[:, :, r]) * _U(0x9E3779B97F4A7C15)
                    keys ^= keys >> _U(29)
                flat = pa.array(keys.view(np.int64).ravel())
                bounds = pa.array(np.arange(0, k * bands + 1, bands, dtype=np.int32))
                low = np.ascontiguousarray(sig.astype(np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [names.slice(a, k), digests.slice(a, k), pa.array(np.diff(part.bounds)), pa.array(np.diff(first) > 0), pa.ListArray.from_arrays(bounds, flat), pa.array([x.tobytes() for x in low], pa.binary())],
                    ["doc_id", "digest", "size", "filled", "bands", "low"],
                )
                release()
        release(0)

    return run


FEATURES = "doc_id long, digest binary, size long, filled boolean, bands array<long>, low binary"


def _agree(hashes: int, least: int):
    """Pairs of which `least` MinHash values agree, by their low bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, hashes) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a == b).sum(1) >= least))

    return run


def jaccard_links(sets_a: list[np.ndarray], sets_b: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of a set of a and one of b whose Jaccard similarity reaches the threshold, all pairs verified."""
    la, lb = np.array([len(x) for x in sets_a], np.float64), np.array([len(x) for x in sets_b], np.float64)
    ids, inverse = np.unique(np.concatenate(sets_a + sets_b), return_inverse=True)
    owner = np.repeat(np.arange(len(la) + len(lb)), np.concatenate([la, lb]).astype(np.int64))
    left = owner < len(la)
    shared = (np.bincount(inverse[left], minlength=len(ids)) > 0) & (np.bincount(inverse[~left], minlength=len(ids)) > 0)
    place = np.cumsum(shared) - 1
    keep = shared[inverse]
    column, owner, left = place[inverse[keep]], owner[keep], left[keep]
    order = np.argsort(column, kind="stable")
    column, owner, left = column[order], owner[order], left[order]
    common, width = np.zeros((len(la), len(lb)), np.float32), 4096
    for c in range(0, int(shared.sum()), width):
        x, y = np.searchsorted(column, [c, c + width])
        at, who, mine = column[x:y] - c, owner[x:y], left[x:y]
        ma, mb = np.zeros((len(la), width), np.float32), np.zeros((len(lb), width), np.float32)
        ma[who[mine], at[mine]] = 1
        mb[who[~mine] - len(la), at[~mine]] = 1
        common += ma @ mb.T
    common = common.astype(np.float64)
    return np.nonzero((common > 0) & (common >= threshold * (la[:, None] + lb[None, :] - common) - 1e-9))


def _verify(n: int, threshold: float):
    """rows of one task (hood, x, y, block, doc_id, copies, text) -> doc_id, links, root."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        release()
        out = []
        rows = rows.drop_duplicates(["hood", "x", "y", "doc_id"]).reset_index(drop=True)
        t = Texts.of(pa.array(rows["text"].to_numpy(object), pa.string()))
        grams, first = exact_ngrams(t, n)
        sets = [np.unique(grams[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        ids, copies, block = rows["doc_id"].to_numpy(), rows["copies"].to_numpy(), rows["block"].to_numpy()
        for (_, x, y), where in rows.groupby(["hood", "x", "y"], sort=False).indices.items():
            at_x, at_y = where[block[where] == x], where[block[where] == y]
            if x == y:
                i, j = jaccard_links([sets[k] for k in at_x], [sets[k] for k in at_x], threshold)
                i, j = at_x[i[i < j]], at_x[j[i < j]]
            elif len(at_x) and len(at_y):
                i, j = jaccard_links([sets[k] for k in at_x], [sets[k] for k in at_y], threshold)
                i, j = at_x[i], at_y[j]
            else:
                continue
            if not len(i):
                continue
            links = np.zeros(len(rows), np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            order = where[np.argsort(ids[where], kind="stable")]
            place = np.zeros(len(rows), np.int64)
            place[order] = np.arange(len(order))
            roots = local_roots(len(order), place[i], place[j])
            linked = links[order] > 0
            out.append(pd.DataFrame({"doc_id": ids[order][linked], "links": links[order][linked], "root": ids[order[roots]][linked]}))
        return pd.concat(out) if out else pd.DataFrame({"doc_id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "root": np.zeros(0, np.int64)})

    return run


def text_digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256))


def jaccard_groups(docs: DataFrame, *, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (smallest doc_id of equal text), n_links (other documents linked), component_id (smallest doc_id
    that links reach), digest (of the text), kept (whether the document stands for its component)."""
    spark, work = docs.sparkSession, stage_path(docs.sparkSession, "jaccard")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest().alias("digest"), F.col("text").cast("string").alias("text"))
    bands, rows = bands_for(threshold, recall, hashes)
    features = staged(texts.mapInArrow(_features(n, hashes, bands, rows), FEATURES), "features", f"{work}/features")
    # a document is named by its doc_id; without one, or for a further text under one, by its text
    every = features.select("doc_id", "digest", "size", "filled")
    every = every.filter("doc_id is not null").distinct().unionByName(every.filter("doc_id is null"))
    first = every.filter("doc_id is not null").groupBy("doc_id").agg(F.min("digest").alias("first"), F.count(F.lit(1)).alias("texts"))
    several = staged(first.filter("texts > 1"), "several", f"{work}/several")
    own = F.col("doc_id").isNull() | (F.col("digest") != F.coalesce("first", "digest"))
    own_id = OWN_IDS + F.pmod(F.xxhash64("digest", F.coalesce("doc_id", F.lit(0))), F.lit(1 << 61))
    every = staged(every.join(several, "doc_id", "left").select("doc_id", "digest", "size", "filled", F.when(own, own_id).otherwise(F.col("doc_id")).alias("node")), "documents")
    classes = staged(every.filter("filled").groupBy("digest").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size")), "classes")
    member = features.filter("filled").select("digest", "bands", "low").join(classes, "digest").dropDuplicates(["rep"])
    member = staged(member, "representatives", f"{work}/representatives")
    banded = member.select("rep", F.posexplode("bands").alias("band", "key"))
    size = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("head"))
    size = staged(size.filter("size > 1"), "buckets", f"{work}/buckets")
    small = banded.join(size.filter(F.col("size") <= few).select("band", "key"), ["band", "key"])
    lists = small.groupBy("band", "key").agg(F.array_sort(F.collect_list("rep")).alias("all"))
    pair = F.explode(F.flatten(F.transform("all", lambda x, i: F.transform(F.slice("all", i + 2, F.size("all")), lambda y: F.struct(x.alias("a"), y.alias("b"))))))
    pairs = lists.select(pair.alias("p")).select("p.a", "p.b").distinct()
    low = member.select("rep", "low")
    both = pairs.join(low.select(F.col("rep").alias("a"), F.col("low").alias("low_a")), "a").join(low.select(F.col("rep").alias("b"), F.col("low").alias("low_b")), "b")
    # five standard deviations below the threshold's expected number of equal values
    least = int(hashes * threshold - 5 * (hashes * threshold * (1 - threshold)) ** 0.5)
    close = both.select("a", "b", "low_a", "low_b").mapInArrow(_agree(hashes, least), "a long, b long")
    stars = banded.join(size.filter(F.col("size") > few), ["band", "key"]).filter("rep <> head").select(F.col("rep").alias("a"), F.col("head").alias("b"))
    hoods = components(close.unionByName(stars).distinct()).withColumnRenamed("node", "rep").withColumnRenamed("component", "hood")
    hoods = staged(hoods.join(member.select("rep", "digest", "copies", "size"), "rep"), "neighbourhoods", f"{work}/neighbourhoods")
    blocks = hoods.groupBy("hood").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("n_blocks"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    sent = blocks.agg(F.sum(F.col("n") * F.col("n_blocks")).alias("rows"), F.sum(F.col("bytes") * F.col("n_blocks")).alias("bytes")).first()
    tasks = max(groups_for(spark, sent["rows"] or 0, 400, 2), groups_for(spark, sent["bytes"] or 0, GROUP_BYTES))
    hoods = hoods.join(blocks.select("hood", "n_blocks"), "hood").withColumn("block", bucket(1 << 20, "rep", salt=3) % F.col("n_blocks"))
    # a block meets each block of its neighbourhood, itself included, in one task
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks").cast("long") - 1))
    named = every.select("digest", "node", "doc_id").join(hoods.select(F.col("rep").alias("node"), "digest", "hood", "copies", "block", "n_blocks"), ["digest", "node"]).dropDuplicates(["node"])
    same = F.col("t.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("t.digest") == F.col("m.digest"))
    joined = texts.alias("t").join(named.alias("m"), same)
    joined = joined.select("hood", "block", "n_blocks", F.col("node").alias("doc_id"), "copies", "text").withColumn("_o", other)
    joined = joined.select("hood", F.least("block", "_o").alias("x"), F.greatest("block", "_o").alias("y"), "block", "doc_id", "copies", "text")
    joined = joined.withColumn("task", F.when(F.col("x") == F.col("y"), bucket(tasks, "hood", "x")).otherwise(bucket(tasks, "hood", "x", "y")))
    found = joined.groupBy("task").applyInPandas(_verify(n, threshold), "doc_id long, links long, root long")
    found = staged(found, "links")
    drop_path(spark, work)  # nothing below reads it
    links = found.groupBy("doc_id").agg(F.sum("links").alias("links"))
    comps = components(found.filter("doc_id <> root").select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    named = classes.join(links.withColumnRenamed("doc_id", "rep"), "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("digest", "rep", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    linked = every.filter("filled").join(named, "digest").select("doc_id", "digest", "node", "rep", "n_links", "component")
    blank = every.filter("not filled").select("doc_id", "digest", "node", F.col("node").alias("rep"), F.lit(0).cast("long").alias("n_links"), F.col("node").alias("component"))
    out = linked.unionByName(blank)
    # numbers of their own back to what they stand for
    ids = staged(every.filter(F.col("node") >= OWN_IDS).groupBy("node").agg(F.min("doc_id").alias("id")), "own-ids")
    for c, to in (("rep", "class_id"), ("component", "component_id")):
        out = out.join(ids.select(F.col("node").alias(c), F.col("id").alias(f"_{c}")), c, "left").withColumn(to, F.when(F.col(c) >= OWN_IDS, F.col(f"_{c}")).otherwise(F.col(c)))
    return out.select("doc_id", "class_id", "n_links", "component_id", "digest", (F.col("node") == F.col("component")).alias("kept"))


def op8_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "component_id")


QUERIES = {"op8_minhash_join": op8_minhash_join}
SQL = {
    "op8_minhash_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS gram
  FROM w, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS s(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING count(*) >= 0.8 * (na.n + nb.n - count(*)) - 1e-9),
r(node, root) AS (
  SELECT a, least(a, b) FROM l
  UNION
  SELECT l.b, r.root FROM r JOIN l ON l.a = r.node)
SELECT d.doc_id, CASE WHEN len(w.ws) > 0 THEN min(d.doc_id) OVER (PARTITION BY d.text) ELSE d.doc_id END AS class_id,
  coalesce(k.n_links, 0) AS n_links, coalesce(c.root, d.doc_id) AS component_id
FROM documents d JOIN w ON w.doc_id = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n_links FROM l GROUP BY a) k ON k.a = d.doc_id
LEFT JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) c ON c.node = d.doc_id
"""
}
