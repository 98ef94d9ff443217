"""Minimum-cost-flow resharding (operator 2).

Old shards have sizes, new shards have capacities. Moving a byte from old shard i to new shard j costs 1, staying (i = j)
costs nothing; a minimum-cost flow says how many bytes go from where to where, and moves the fewest bytes that the
capacities allow. Documents follow: within an old shard they are ordered by the hash of their text, and consecutive
ranges of that order are the flow's blocks. So equal texts, which are in one old shard, stay together.

A group of equal texts above 1/HEAVY of a capacity can't be cut as the flow likes. Such groups are placed together with the
flow of the rest: by trying all placements where there are at most EXACT of them, else in each shard those stay that
fill it best, and the others go where they push out the least. The plan states the bytes moved beside the flow's bound,
which no layout can beat. A group larger than any shard is split by rows. There are at most HEAVY such groups a shard.

The old layout is one folder of files for each old shard, a file for each range of hashes (heavy groups have files of
their own). rewrite() reads and writes the files that lose documents, and no others: a file whose documents all stay is
kept where it is, and files that arrive are added.

What goes through the driver: old shard sizes, the heavy groups' sizes, the sizes of hash buckets around the cuts, and the
list of files. No table is ranked by a single task: a document's slot is its place in its shard's files.

Defined results: a null text has size 1 and the checksum of no bytes; rows that repeat are separate documents; a null
doc_id is kept; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claraudit.llm.common import freed_shuffles, stage_path, staged

SHARDS, OLD_SHARDS, HEAVY, GRAIN = 8, 12, 256, 4096
#: Placements of heavy groups that are all tried; bytes of a file, about; files of a shard at least.
EXACT, FILE_BYTES, FILES = 1 << 16, 128 << 20, 8


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """flow[i][j] of least total cost that sends all supplies within the capacities, by successive shortest paths. The
    graph has as many nodes as shards, so this is a small computation whatever the data."""
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities don't hold the supplies")
    n, m = len(supply), len(capacity)
    source, sink, total = n + m, n + m + 1, n + m + 2
    to, room, price, out = [], [], [], [[] for _ in range(total)]

    def edge(a: int, b: int, cap: int, c: int) -> None:
        for x, y, k, p in ((a, b, cap, c), (b, a, 0, -c)):
            out[x].append(len(to))
            to.append(y)
            room.append(k)
            price.append(p)

    for i, s in enumerate(supply):
        edge(source, i, s, 0)
    at = {}
    for i in range(n):
        for j in range(m):
            at[i, j] = len(to)
            edge(i, n + j, supply[i], cost[i][j])
    for j, c in enumerate(capacity):
        edge(n + j, sink, c, 0)
    left = sum(supply)
    while left:
        far, by, queue = [None] * total, [-1] * total, [source]
        far[source] = 0
        while queue:  # Bellman-Ford with a queue: residual prices may be negative
            a = queue.pop(0)
            for e in out[a]:
                if room[e] and (far[to[e]] is None or far[a] + price[e] < far[to[e]]):
                    far[to[e]], by[to[e]] = far[a] + price[e], e
                    queue.append(to[e])
        path, node = [], sink
        while node != source:
            path.append(by[node])
            node = to[by[node] ^ 1]
        k = min(left, *(room[e] for e in path))
        for e in path:
            room[e] -= k
            room[e ^ 1] += k
        left -= k
    return [[room[at[i, j] ^ 1] for j in range(m)] for i in range(n)]


def even_capacities(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


def plan_transfers(old_sizes: Sequence[int], capacities: Sequence[int], place: Sequence[int] | None = None) -> list[list[int]]:
    """Bytes from each old shard to each new one, fewest moved. place[i]: the new shard that lies where old shard i does."""
    place = list(range(len(old_sizes))) if place is None else place
    return min_cost_flow(old_sizes, capacities, [[0 if place[i] == j else 1 for j in range(len(capacities))] for i in range(len(old_sizes))])


def moved_bytes(groups: Sequence[tuple[int, int, int]], where: Sequence[int], light: Sequence[int], capacities: Sequence[int]) -> int | None:
    """Bytes moved where group k goes to shard where[k] and the rest flows as it is best; None if a shard overflows. All moves
    cost the same a byte, so the flow keeps in each shard what has room."""
    room = list(capacities)
    moved = sum(light)
    for (_, old, size), j in zip(groups, where, strict=True):
        room[j] -= size
        moved += size * (old != j)
    if min(room) < 0:
        return None
    return moved - sum(min(x, r) for x, r in zip(light, room, strict=False))


def _best_stay(sizes: list[int], light: int, capacity: int) -> set[int]:
    """Indices of the groups that stay in their shard: large ones first, then the best of all choices of the last few."""
    order, total, stay = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)), 0, set()
    for k in order[:-12]:
        if total + sizes[k] <= capacity:
            total += sizes[k]
            stay.add(k)
    best, chosen = -1, ()
    rest = order[-12:]
    for picks in product((True, False), repeat=len(rest)):
        more = [k for k, x in zip(rest, picks, strict=True) if x]
        here = total + sum(sizes[k] for k in more)
        if here <= capacity and min(capacity, here + light) > best:
            best, chosen = min(capacity, here + light), more
    return stay | set(chosen)


def place_heavy(groups: Sequence[tuple[int, int, int]], light: Sequence[int], capacities: Sequence[int]) -> tuple[dict[int, int], set[int]]:
    """(group -> shard, groups to split by rows). groups: (hash, old shard, bytes); light: each old shard's other bytes."""
    n = len(capacities)
    groups = sorted(groups, key=lambda x: (-x[2], x[0]))
    split = {g for g, _, size in groups if size > max(capacities)}
    light = list(light)
    for g, old, size in groups:
        if g in split:
            light[old] += size
    groups = [x for x in groups if x[0] not in split]
    if not groups:
        return {}, split
    if n ** len(groups) <= EXACT:
        tried = ((moved_bytes(groups, where, light, capacities), where) for where in product(range(n), repeat=len(groups)))
        best = min((x for x in tried if x[0] is not None), default=None)
        if best is not None:
            return {g: j for (g, _, _), j in zip(groups, best[1], strict=True)}, split
    placed: dict[int, int] = {}
    room = list(capacities)
    for j in range(min(n, len(light))):
        own = [x for x in groups if x[1] == j]
        for k in _best_stay([x[2] for x in own], light[j], capacities[j]):
            placed[own[k][0]] = j
            room[j] -= own[k][2]
    for g, old, size in groups:
        if g in placed:
            continue
        free = [room[j] - (min(light[j], room[j]) if j < len(light) else 0) for j in range(n)]
        fits = [j for j in range(n) if free[j] >= size]
        j = min(fits, key=lambda j: (free[j], j)) if fits else max(range(n), key=lambda j: (min(room[j], size), free[j], -j))
        if room[j] < size:
            split.add(g)
            light[old] += size
        else:
            placed[g] = j
            room[j] -= size
    return placed, split


def reshard(docs: DataFrame, *, n_new: int = SHARDS, n_old: int = OLD_SHARDS, heavy: int = HEAVY, path: str | None = None) -> tuple[DataFrame, dict]:
    """Writes the old layout (old shard = hash of the text modulo n_old), plans, and rewrites the affected files. Gives
    (doc_id, text, group, old_shard, shard, slot), read from the new layout's files, and the plan: flow, capacities,
    bytes_moved, bound, kept (files that stay as they are) and affected, by (old shard, file)."""
    spark, path = docs.sparkSession, path or stage_path(docs.sparkSession, "shards")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    group = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull())
    base = base.withColumn("group", group).withColumn("old_shard", F.pmod("group", F.lit(n_old)).cast("int"))
    sizes = base.withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"))
    groups = staged(sizes.groupBy("group", "old_shard").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "groups")
    old = {r["old_shard"]: r["bytes"] for r in groups.groupBy("old_shard").agg(F.sum("bytes").alias("bytes")).collect()}
    total = sum(old.values())
    capacities = even_capacities(total, n_new)
    if not total:
        none = base.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")).filter(F.lit(False))
        return none, {"flow": [], "capacities": capacities, "bytes_moved": 0, "bound": 0, "kept": [], "affected": [], "path": path}
    least = max(capacities, default=0) // heavy
    large = [(r["group"], r["old_shard"], r["bytes"]) for r in groups.filter(F.col("bytes") > least).collect()]  # n_new * heavy at most
    light = [old.get(i, 0) - sum(s for _, o, s in large if o == i) for i in range(n_old)]
    placed, split = place_heavy(large, light, capacities) 
    room = list(capacities)
    for g, i, size in large:
        if g in placed:
            room[placed[g]] -= size
        else:
            light[i] += size  # a group to split takes part by rows
    flow = plan_transfers(light, room)
    moved = sum(f for i, row in enumerate(flow) for j, f in enumerate(row) if i != j) + sum(s for g, i, s in large if g in placed and placed[g] != i)
    bound = total - sum(min(old.get(j, 0), c) for j, c in enumerate(capacities))
    files = max(FILES, -(-max(old.values(), default=0) // FILE_BYTES))
    _write_old(base, f"{path}/old", large, files, max(1, total // (n_old * files)))
    layout = spark.read.parquet(f"{path}/old")
    shard = _shard_of(_cuts(spark, groups, placed, split, flow), n_old)
    if placed:
        fixed = spark.createDataFrame(sorted(placed.items()), "group long, fixed int")  # n_new * heavy rows at most
        to = lambda rows: rows.join(F.broadcast(fixed), "group", "left").withColumn("shard", F.coalesce("fixed", shard)).drop("fixed")
    else:
        to = lambda rows: rows.withColumn("shard", shard)
    state = to(layout.select("doc_id", "group", "old_shard", "file")).groupBy("old_shard", "file").agg(F.max(F.col("shard") != F.col("old_shard")).alias("moves")).collect()  # a row a file
    affected = sorted((r["old_shard"], r["file"]) for r in state if r["moves"])
    kept = sorted((r["old_shard"], r["file"]) for r in state if not r["moves"])
    rewrite(to(layout.filter(_among(affected))), f"{path}/new", len(affected))
    new = _placed(layout.filter(_among(kept)).withColumn("shard", F.col("old_shard")))
    if affected:
        new = new.unionByName(_placed(spark.read.parquet(f"{path}/new")))
    return _with_slots(new), {"flow": flow, "capacities": capacities, "bytes_moved": moved, "bound": bound, "kept": kept, "affected": affected, "path": path}


def _among(files: list[tuple[int, int]]) -> Column:
    """Partition filter: the files listed, as ranges of numbers."""
    out = F.lit(False)
    for i in sorted({i for i, _ in files}):
        out = out | ((F.col("old_shard") == i) & F.col("file").isin([f for o, f in files if o == i]))
    return out


def _write_old(base: DataFrame, path: str, large: list[tuple[int, int, int]], files: int, file_bytes: int) -> None:
    """One folder for each old shard and file, each written by one task. A group larger than a file has
    files of its own, by rows."""
    spark = base.sparkSession
    file = F.floor((F.col("group") / F.lit(float(1 << 64)) + 0.5) * files).cast("int")
    large = [x for x in large if x[2] > file_bytes]
    if large:
        own, rows = files, []
        for g, _, size in sorted(large):
            k = -(-size // file_bytes)
            rows.append((g, own, k))
            own += k
        parts = F.broadcast(spark.createDataFrame(rows, "group long, first int, parts int"))  # as many rows as heavy groups
        any_row = F.xxhash64("doc_id", F.monotonically_increasing_id())
        base = base.join(parts, "group", "left").withColumn("file", F.coalesce(F.col("first") + F.pmod(any_row, F.col("parts")).cast("int"), file)).drop("first", "parts")
    else:
        base = base.withColumn("file", file)
    with freed_shuffles(spark):
        base.repartition("old_shard", "file").write.partitionBy("old_shard", "file").parquet(path)


def _cuts(spark: SparkSession, groups: DataFrame, placed: dict, split: set, flow: list) -> list[list[tuple[int, tuple[int, int] | None]]]:
    """For each old shard its blocks in order: (new shard, first (group, document hash) of the next block or None)."""
    light = groups.filter(~F.col("group").isin(list(placed))) if placed else groups
    grain = F.floor(F.col("group") / F.lit((1 << 64) // GRAIN)).cast("long")
    sums = light.withColumn("grain", grain).groupBy("old_shard", "grain").agg(F.sum("bytes").alias("bytes")).collect()  # n_old * GRAIN at most
    by: dict[int, list[tuple[int, int]]] = {}
    for r in sorted(sums, key=lambda r: (r["old_shard"], r["grain"])):
        by.setdefault(r["old_shard"], []).append((r["grain"], r["bytes"]))
    wanted: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (old, grain) -> (bytes into the grain, block)
    blocks: list[list[list]] = []
    for i, row in enumerate(flow):
        parts = [(j, f) for j, f in enumerate(row) if f]
        blocks.append([[j, None] for j, _ in parts])
        at = 0
        for b, (_, f) in enumerate(parts[:-1]):
            at += f
            before = 0
            for g, size in by.get(i, []):
                if before + size > at:
                    wanted.setdefault((i, g), []).append((at - before, b))
                    break
                before += size
    if wanted:
        some = F.lit(False)
        for i, g in wanted:
            some = some | ((F.col("old_shard") == i) & (F.col("grain") == g))
        order = Window.partitionBy("old_shard", "grain").orderBy("group")
        inside = light.withColumn("grain", grain).filter(some).withColumn("end", F.sum("bytes").over(order))
        marks = F.broadcast(spark.createDataFrame([(i, g, need, b) for (i, g), x in wanted.items() for need, b in x], "old_shard int, grain long, need long, block int"))  # n_old * n_new rows at most
        # the first group that ends beyond the mark starts the next block if most of it lies there
        found = inside.join(marks, ["old_shard", "grain"]).filter("end > need").groupBy("old_shard", "block", "need").agg(F.min(F.struct("end", "group", "bytes")).alias("at"))
        for r in found.collect():
            need, (end, group, size) = r["need"], r["at"]
            if group in split:
                at = (group, _split_at(need - (end - size), size))
            else:
                at = (group + 1 if end - need < need - (end - size) else group, -(1 << 63))
            blocks[r["old_shard"]][r["block"]][1] = at
    return [[(j, k) for j, k in x] for x in blocks]


def _split_at(need: int, size: int) -> int:
    """The document hash below which about `need` of a group's `size` bytes lie. All its texts are equal and hashes are
    uniform, so a share of the bytes is the same share of the hash range."""
    return int(-(1 << 63) + (need * ((1 << 64) - 1)) // max(1, size))


def _shard_of(cuts: list, n_old: int) -> Column:
    out = F.lit(0)
    for i, parts in enumerate(cuts):
        here = F.lit(parts[-1][0] if parts else 0)
        for j, k in reversed(parts[:-1]):
            if k is None:
                continue
            group, sub = k
            before = F.col("group") < group
            if sub > -(1 << 63):
                before = before | ((F.col("group") == group) & (F.xxhash64(F.lit(2), "doc_id", "file") < sub))
            here = F.when(before, j).otherwise(here)
        out = F.when(F.col("old_shard") == i, here).otherwise(out)
    return out.cast("int")


def rewrite(assigned: DataFrame, path: str, n_files: int) -> None:
    """Write the documents of the affected files, one folder for each new shard; each task has a few old files' documents."""
    if n_files:
        with freed_shuffles(assigned.sparkSession):
            assigned.repartition("shard", F.pmod(F.xxhash64("group", "doc_id", "file"), F.lit(-(-n_files // 4)))).drop("file").write.partitionBy("shard").parquet(path)


def _placed(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "text", "group", "old_shard", F.col("shard").cast("int").alias("shard"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))


def _with_slots(rows: DataFrame) -> DataFrame:
    """slot: a document's place in its shard's files, one after the other, gapless from 0."""
    files = rows.groupBy("shard", "_file").agg(F.count(F.lit(1)).alias("_n"))  # a row a file
    before = files.select("shard", "_file", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_file")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), ["shard", "_file"]).withColumn("slot", (F.col("_before") + F.col("_at")).cast("long")).drop("_file", "_at", "_before")


def op2_min_cost_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = reshard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = F.coalesce("text", F.lit(""))
    size, crc = (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    return rows.select("doc_id", size, crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


QUERIES = {"op2_min_cost_flow": op2_min_cost_flow}
SQL: dict[str, str] = {}
