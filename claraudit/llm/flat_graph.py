"""Embedding near-dedup by a robust-pruned flat graph (operator 7).

1. Equal vectors are one point, with the smallest id and the number of copies.
2. Centroids are a sample of the points, one for each `shard_points` of them. Each point goes to the `overlap` nearest
   centroids: clusters overlap, so a near pair shares one although a border lies between. Where that takes more centroids
   than CENTROIDS or CENTROID_BYTES allow a task to hold, there are two levels: each cluster of the first is divided by a
   sample of its own points in the same way, so shards keep their size whatever the number of points.
3. In each cluster shard every point's nearest points by inner product are its candidates, and robust pruning keeps those
   that no kept one is much nearer to. The lists that shards give to one point are united: one flat graph.
4. Each shard then searches for every point of it: greedy beam search from the shard's medoids over the united lists,
   then range expansion, which walks on through all points found within the threshold. What the walk meets is verified by
   its cosine in double precision. A pair that several shards hold counts in the first of them. A walk stays in its
   shard: a pair that shares none is missed, which is what the audit measures and overlap makes rare.
5. Points are compared with all vectors by brute force, more and more of them until `audit_links` links were seen (or
   AUDIT_MOST points); if fewer than `audit_recall` of these links were found, everything is done again with one more
   cluster for each point.
6. Shards give numbers of links and a spanning star of each local component; components join them.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components links with nothing; all other
magnitudes do (vectors are scaled by their largest component before anything is squared); vectors of different lengths
don't link; rows repeating (vec_id, embedding) are one vector; a row without a vec_id links with nothing and is returned
with nulls; recall is null where the audit saw no link; an empty table gives no rows; all ties go to the smaller id; other
columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claraudit.llm.common import release, staged
from claraudit.llm.components import components, local_roots

THRESHOLD, OVERLAP, DEGREE, ALPHA, BEAM = 0.9, 2, 24, 1.2, 24
#: Points of a shard, about; most centroids of one vector length that a task holds, and their bytes.
SHARD_POINTS, CENTROIDS, CENTROID_BYTES = 384, 8192, 16 << 20
#: The audit: points at first and at most, links to see, recall to reach.
AUDITED, AUDIT_MOST, AUDIT_LINKS, AUDIT_RECALL = 96, 1536, 300, 0.98


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, pool: int = 96) -> np.ndarray:
    """Neighbour lists (n x degree, -1 where shorter): of each point's `pool` nearest, in order, those are kept that no kept
    one is alpha times nearer to than the point itself. Distances are of unit vectors."""
    n = len(x)
    pool = min(pool, n - 1)
    out = np.full((n, degree), -1, np.int64)
    for a in range(0, n, 512):
        sims = x[a : a + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -np.inf
        near = np.argpartition(-sims, pool - 1, axis=1)[:, :pool] if pool < n - 1 else np.argsort(-sims, axis=1)[:, :pool]
        own = np.take_along_axis(sims, near, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        near, own = np.take_along_axis(near, order, 1), np.sqrt(np.maximum(0, 2 - 2 * np.take_along_axis(own, order, 1)))
        alive, kept = np.ones(near.shape, bool), np.zeros(len(near), np.int64)
        rows = np.arange(len(near))
        for _ in range(degree):
            some = alive.any(1)
            if not some.any():
                break
            first = alive.argmax(1)
            pick = near[rows, first]
            out[a + rows[some], kept[some]] = pick[some]
            kept[some] += 1
            apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("nd,npd->np", x[pick], x[near])))
            alive &= ~(alpha * apart <= own) & some[:, None]
            alive[rows, first] = False
    return out


def medoids(x: np.ndarray, k: int = 4) -> np.ndarray:
    """The point nearest to the mean, and k - 1 more, each the one least like those chosen before."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    most = x @ x[chosen[0]]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(int(np.argmin(most)))
        most = np.maximum(most, x @ x[chosen[-1]])
    return np.array(chosen)


def range_search(x: np.ndarray, graph: np.ndarray, threshold: float, beam: int = BEAM, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, found) pairs with x[query] . x[found] >= threshold, query < found, that beam search from the medoids and
    range expansion over graph (n x d, -1 filled) meet. All queries go in step."""
    n, d = len(x), graph.shape[1]
    if n < 2 or not d:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = medoids(x) if starts is None else starts
    links_a, links_b, step = [], [], 1024
    for lo in range(0, n, step):
        q = x[lo : lo + step]
        m, rows = len(q), np.arange(len(q))
        seen = np.zeros((m, n), bool)
        seen[:, starts] = True
        ids = np.full((m, beam), -1, np.int64)
        sims = np.full((m, beam), -np.inf)
        k = min(beam, len(starts))
        first = np.argsort(-(q @ x[starts].T), axis=1, kind="stable")[:, :k]
        ids[:, :k] = starts[first]
        sims[:, :k] = np.take_along_axis(q @ x[starts].T, first, 1)
        opened = np.zeros((m, beam), bool)
        while True:
            open_sims = np.where(opened | (ids < 0), -np.inf, sims)
            best = open_sims.argmax(1)
            act = rows[open_sims[rows, best] > -np.inf]
            if not len(act):
                break
            opened[act, best[act]] = True
            near = graph[ids[act, best[act]]]
            fresh = (near >= 0) & ~seen[act[:, None], np.maximum(near, 0)]
            seen[np.repeat(act, fresh.sum(1)), near[fresh]] = True
            value = np.where(fresh, np.einsum("md,mkd->mk", q[act], x[np.maximum(near, 0)]), -np.inf)
            all_ids, all_sims = np.concatenate([ids[act], near], 1), np.concatenate([sims[act], value], 1)
            all_open = np.concatenate([opened[act], np.zeros(near.shape, bool)], 1)
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[act], sims[act] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_sims, order, 1)
            ids[act] = np.where(np.isfinite(sims[act]), ids[act], -1)
            opened[act] = np.take_along_axis(all_open, order, 1)
        # range expansion: from everything within the threshold to its neighbours, as long as that finds more
        met = np.zeros((m, n), bool)
        r, c = np.nonzero((sims >= threshold - 1e-9) & (ids >= 0))
        front_q, front_p = r, ids[r, c]
        met[front_q, front_p] = True
        while len(front_q):
            near = graph[front_p]
            pair_q, pair_p = np.repeat(front_q, (near >= 0).sum(1)), near[near >= 0]
            new = ~met[pair_q, pair_p]
            key = np.unique(pair_q[new] * n + pair_p[new])
            pair_q, pair_p = key // n, key % n
            inside = np.zeros(len(key), bool)
            for i in range(0, len(key), 1 << 16):
                s = slice(i, i + (1 << 16))
                inside[s] = np.einsum("kd,kd->k", q[pair_q[s]], x[pair_p[s]]) >= threshold - 1e-9
            front_q, front_p = pair_q[inside], pair_p[inside]
            met[front_q, front_p] = True
        a, b = np.nonzero(met)
        a = a + lo
        off = a != b
        links_a.append(np.minimum(a, b)[off])
        links_b.append(np.maximum(a, b)[off])
    key = np.unique(np.concatenate(links_a) * n + np.concatenate(links_b))
    return key // n, key % n


def _assign(centroids: dict[int, np.ndarray], names: dict[int, np.ndarray], overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, length = batch.column(0).to_numpy(), np.array([len(v) for v in batch.column(2).to_pylist()])
            for d in np.unique(length).tolist():
                at = np.flatnonzero(length == d)
                x, c = _unit(_matrix(batch.column(2).take(pa.array(at)))), centroids[d]
                k = min(overlap, len(c))
                sims = x @ c.T
                near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(k), (len(x), 1))
                homes = np.sort(names[d][near], axis=1)
                part = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), part.column(1), part.column(2), pa.array(homes.tolist(), pa.list_(pa.int64()))], ["rep", "copies", "vector", "homes"])

    return run


def _divide(shard_points: int, overlap: int):
    """One first-level cluster of one vector length: its points' shards of the second level."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep", kind="stable").reset_index(drop=True)
        x = _unit(np.stack(rows["vector"].to_numpy()))
        k = max(1, -(-len(x) // shard_points))
        some = np.sort(np.random.default_rng(len(x)).permutation(len(x))[:k])  # the same points on every run
        few, parts = min(overlap, k), []
        for a in range(0, len(x), 4096):
            sims = x[a : a + 4096] @ x[some].T
            near = np.argpartition(-sims, few - 1, axis=1)[:, :few] if few < k else np.tile(np.arange(k), (len(sims), 1))
            parts.append(near)
        near = np.concatenate(parts)
        return pd.DataFrame({"rep": rows["rep"], "copies": rows["copies"], "vector": rows["vector"], "found": list((int(key[0]) << 24) + near.astype(np.int64))})

    return run


def _build(degree: int, alpha: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        release()
        ids = rows["rep"].to_numpy()
        graph = robust_prune(_unit(np.stack(rows["vector"].to_numpy())), degree, alpha) if len(ids) > 1 else np.full((len(ids), 1), -1)
        return pd.DataFrame({"rep": ids, "near": [ids[g[g >= 0]] for g in graph]})

    return run


def _search(threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        release()
        rows = rows.sort_values("rep", kind="stable")
        ids, copies, shard = rows["rep"].to_numpy(), rows["copies"].to_numpy(), key[0]
        near = rows["near"].to_numpy()
        flat = np.concatenate([np.asarray(v, np.int64) for v in near])
        place = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        here, owner = ids[place] == flat, np.repeat(np.arange(len(ids)), [len(v) for v in near])
        place, owner = place[here], owner[here]
        counts = np.bincount(owner, minlength=len(ids))
        graph = np.full((len(ids), max(1, counts.max(initial=0))), -1, np.int64)
        graph[owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)] = place
        x = _unit(np.stack(rows["vector"].to_numpy()))
        a, b = range_search(x, graph, threshold)
        good = np.einsum("kd,kd->k", x[a], x[b]) >= threshold  # verified in double precision
        lists = rows["homes"].to_numpy()
        homes = np.full((len(ids), max(map(len, lists))), -1, np.int64)
        for i, x in enumerate(lists):
            homes[i, : len(x)] = x
        common = (homes[a][:, :, None] == homes[b][:, None, :]) & (homes[a][:, :, None] >= 0)
        first = np.where(common.any(2), homes[a], np.iinfo(np.int64).max).min(1)
        good &= first == shard
        a, b = a[good], b[good]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        roots, linked = local_roots(len(ids), a, b), links > 0
        return pd.DataFrame({"rep": ids[linked], "links": links[linked], "root": ids[roots][linked]})

    return run


def _brute(sample: dict[int, tuple[np.ndarray, np.ndarray]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            length = np.array([len(v) for v in batch.column(2).to_pylist()])
            for d, (names, q) in sample.items():
                at = np.flatnonzero(length == d)
                if len(at):
                    hit = (q @ _unit(_matrix(batch.column(2).take(pa.array(at)))).T >= threshold) & (names[:, None] != ids[at][None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array((hit * copies[at][None, :]).sum(1).astype(np.int64))], ["rep", "truth"])

    return run


def _lengths(points: DataFrame) -> dict[int, int]:
    """Points of each vector length."""
    return {r["d"]: r["n"] for r in points.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}


def _sampled(points: DataFrame, most: dict[int, int], salt: int, skip: int = 0) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """`most` points of each vector length behind the first `skip`, by the smallest hashes: a bounded sample for the driver."""
    order = F.struct(F.xxhash64(F.lit(salt), "rep").alias("h"), "rep", "vector")
    out = {}
    for d, k in most.items():
        rows = points.filter(F.size("vector") == d).select(order.alias("o")).orderBy("o.h", "o.rep").limit(skip + k).collect()[skip:]
        if rows:
            out[d] = (np.array([r["o"]["rep"] for r in rows], np.int64), _unit(np.array([r["o"]["vector"] for r in rows], np.float64)))
    return out


def _truth(points: DataFrame, lengths: dict[int, int], threshold: float, links: int) -> DataFrame:
    """(rep, truth): the true number of links of enough points to have seen `links` links, if there are."""
    spark, at, seen, parts = points.sparkSession, 0, 0, []
    while at < AUDIT_MOST and seen < links:
        n = AUDITED if not at else at
        some = _sampled(points, dict.fromkeys(lengths, n), 11, at)
        if not some:
            break
        got = points.mapInArrow(_brute(some, threshold), "rep long, truth long").groupBy("rep").agg(F.sum("truth").alias("truth")).collect()  # `n` rows a length at most
        parts += [(r["rep"], r["truth"]) for r in got]
        seen += sum(r["truth"] for r in got)
        at += n
    return spark.createDataFrame(parts, "rep long, truth long")


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, overlap: int = OVERLAP, degree: int = DEGREE, alpha: float = ALPHA, shard_points: int = SHARD_POINTS, centroids: int = CENTROIDS, audit_recall: float = AUDIT_RECALL, audit_links: int = AUDIT_LINKS) -> DataFrame:
    """vec_id, n_links, component_id, kept, recall (of the audit; null where it saw no link) and audit_links (that it saw)."""
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = every.filter("vec_id is not null")
    inf = F.lit(float("inf"))
    fine = (F.size("vector") > 0) & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == inf)) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("good", F.coalesce(F.col("vector").isNotNull() & fine, F.lit(False)))
    good = rows.filter("good").select("vec_id", "vector").distinct()
    bad = rows.filter("not good").select("vec_id").distinct().join(good.select("vec_id"), "vec_id", "left_anti")
    points = staged(good.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).select("rep", "copies", "vector"), "points")
    lengths = _lengths(points)
    truth = _truth(points, lengths, threshold, audit_links)
    wanted = {d: -(-n // shard_points) for d, n in lengths.items()}
    held = {d: max(1, min(k, centroids, CENTROID_BYTES // (8 * d))) for d, k in wanted.items()}
    two = any(wanted[d] > held[d] for d in wanted)
    centers = _sampled(points, held, 12)
    while True:
        names, at = {}, 0
        for d, (_, c) in sorted(centers.items()):
            names[d] = np.arange(at, at + len(c))
            at += len(c)
        homes = points.mapInArrow(_assign({d: c for d, (_, c) in centers.items()}, names, overlap), "rep long, copies long, vector array<double>, homes array<long>")
        if two:
            within = homes.select(F.explode("homes").alias("cluster"), "rep", "copies", "vector").groupBy("cluster").applyInPandas(_divide(shard_points, overlap), "rep long, copies long, vector array<double>, found array<long>")
            # at most overlap lists each
            homes = within.groupBy("rep").agg(F.first("copies").alias("copies"), F.first("vector").alias("vector"), F.array_sort(F.flatten(F.collect_list("found"))).alias("homes"))
        homes = staged(homes, "homes")
        sharded = homes.select(F.explode("homes").alias("shard"), "rep", "copies", "vector", "homes")
        lists = sharded.select("shard", "rep", "vector").groupBy("shard").applyInPandas(_build(degree, alpha), "rep long, near array<long>")
        graph = staged(lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")  # at most overlap lists each
        found = sharded.join(graph, "rep").groupBy("shard").applyInPandas(_search(threshold), "rep long, links long, root long")
        found = staged(found, "vector-links")
        links = found.groupBy("rep").agg(F.sum("links").alias("links"))
        audit = truth.join(links, "rep", "left").agg(F.sum("truth").alias("t"), F.sum(F.least("truth", F.coalesce("links", F.lit(0)))).alias("f")).first()
        recall = audit["f"] / audit["t"] if audit["t"] else None
        if recall is None or recall >= audit_recall or overlap >= at:
            break
        overlap += 1
    comps = components(found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = points.join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = good.join(named, "vector").select("vec_id", "n_links", "component_id")
    none = F.lit(0).cast("long").alias("n_links")
    out = out.unionByName(bad.select("vec_id", none, F.col("vec_id").alias("component_id")))
    out = out.unionByName(every.filter("vec_id is null").select("vec_id", none, F.col("vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"), F.lit(recall).cast("double").alias("recall"), F.lit(audit["t"] or 0).cast("long").alias("audit_links"))


def op7_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op7_flat_graph": op7_flat_graph}
SQL: dict[str, str] = {}
