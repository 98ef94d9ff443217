"""Mixing sources to target weights by Pfair scheduling (operator 5). DataFrame functions only.

Each source's documents, in a hashed order, are dealt into blocks of a fixed number of documents (a source's last block
may be smaller). In the ideal mix all sources run at once, each at its exact weight, until it has no blocks left; from
then on the others share its slots, by their weights. A block is released in the slot in which the ideal mix begins it
and due at the end of that in which it ends it; in each slot the released block with the earliest deadline goes (ties:
the first source by name). So at any time each source has had less than a block more or less than in the ideal mix.
Times are rounded to a millionth of a slot.

The ideal mix is arithmetic: sources end in the order of blocks / weight, and between two ends time is linear. Blocks
are scheduled in steps of `period` slots, one after the other, each of which hands the blocks that are released and not
yet scheduled (at most one a source) to the next; results don't depend on it. Ranks come from counts by (source, hash
bucket), summed up over buckets, and a row number inside a bucket, so that no task ranks a whole source.

Bound: a step's blocks, and a row for each source, are held together, never documents. Steps can't run side by side;
there is one for each `period` * `block_docs` documents. Any number of sources goes, unless MAX_SOURCES is set.

Defined results: every row gets exactly one position, whatever its weight; sources of weight 0 or less come after all
others, in equal shares; a null source is a source of its own; sources without a stated weight get the smallest stated
one; text isn't read; rows may repeat; an empty table gives no rows; other columns are kept, but mix_slot and
mix_position, which are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claraudit.llm.common import bucket, groups_for, stage_path, staged

BLOCK_DOCS, PERIOD, MAX_SOURCES = 16, 4096, math.inf
_RUN = 4096
_JOB = "struct<due:bigint,_source:string,_block:bigint>"


def _ceil_div(a: Column, b: Column) -> Column:
    return F.floor((a + b - 1) / b)


def ranked(docs: DataFrame, source: Column, key: str, n_rows: int) -> DataFrame:
    """Adds _source, _rank (from 0, in a hashed order) and no other column."""
    n = groups_for(docs.sparkSession, n_rows, 20_000)
    rows = docs.withColumn("_source", source).withColumn("_bucket", bucket(n, key, salt=5))
    counts = rows.groupBy("_source", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_source").orderBy("_bucket")
    before = counts.select("_source", "_bucket", (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_source", "_bucket").orderBy(F.xxhash64(F.lit(7), key), key)
    rows = rows.withColumn("_row", F.row_number().over(inside) - 1)
    return rows.join(before, ["_source", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_row")).drop("_bucket", "_before", "_row")


def shares(counts: DataFrame, weights: DataFrame | None) -> DataFrame:
    """_source, n (documents), w (above 0), late (after all others). Weights default to the square root of a source's size."""
    if weights is None:
        w = counts.withColumn("w", F.sqrt("n"))
    else:
        w = counts.join(weights.select(F.col("source").alias("_source"), F.col("weight").cast("double").alias("w")), "_source", "left")
    w = w.join(F.broadcast(w.agg(F.min("w").alias("least"))), F.lit(True)).withColumn("w", F.coalesce("w", "least", F.lit(1.0)))  # one row
    late = F.col("w") <= 0
    return w.select("_source", "n", F.when(late, 1.0).otherwise(F.col("w")).alias("w"), late.alias("late"))


def windows(plan: DataFrame, block_docs: int, slots: int) -> DataFrame:
    """_source, _block (from 0), release, due, docs for each block. plan: shares with blocks."""
    plan = plan.withColumn("end", F.col("blocks") / F.col("w"))
    up, down = Window.partitionBy("late").orderBy("end", "_source"), Window.partitionBy("late").orderBy(F.desc("end"), F.desc("_source"))
    ends = plan.withColumn("before", F.sum("blocks").over(up) - F.col("blocks")).withColumn("rest", F.sum("w").over(down))
    ends = ends.groupBy("late").agg(F.array_sort(F.collect_list(F.struct("end", "_source", "before", "rest"))).alias("ends"), F.sum("blocks").alias("total"))
    first = plan.agg(F.coalesce(F.sum(F.when(~F.col("late"), F.col("blocks"))), F.lit(0)).alias("first"))  # one row
    ends = ends.join(F.broadcast(first), F.lit(True)).withColumn("start", F.when(F.col("late"), F.col("first")).otherwise(0))
    rows = plan.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / _RUN)))).repartition("_source", "_run")
    rows = rows.withColumn("_block", F.explode(F.sequence(F.col("_run") * _RUN, F.least(F.col("blocks"), (F.col("_run") + 1) * _RUN) - 1)))
    rows = rows.join(F.broadcast(ends), "late")  # two rows at most

    def slot(k: Column) -> Column:
        v, n = k / F.col("w"), F.size("ends")
        powers = F.array(*[F.lit(1 << i) for i in range(30, -1, -1)])  # binary search: sources that have ended
        ended = F.aggregate(powers, F.lit(0), lambda at, x: F.when((x <= n - at) & (F.get("ends", at + x - 1)["end"] <= v), at + x).otherwise(at))
        here = F.get("ends", ended)
        return F.round(F.col("start") + F.coalesce(here["before"] + v * here["rest"], F.col("total").cast("double")), 6)

    docs = F.least(F.lit(block_docs), F.col("n") - F.col("_block") * block_docs)
    release = F.least(F.floor(slot(F.col("_block"))), F.lit(slots - 1))
    return rows.select("_source", "_block", release.cast("long").alias("release"), F.ceil(slot(F.col("_block") + 1)).cast("long").alias("due"), docs.cast("long").alias("docs"))


def schedule(arriving: Column, pending: Column) -> Column:
    """Earliest deadline first. arriving: for each slot, the blocks released in it; pending: those released before.
    Result: out (the blocks in the order of their slots) and pending."""

    def step(state: Column, x: Column) -> Column:
        ready = F.concat(state["pending"], x["jobs"])
        best = F.array_min(ready)
        going = F.struct(F.array_remove(ready, best).alias("pending"), F.concat(state["out"], F.array(best)).alias("out"))
        return F.when(F.size(ready) > 0, going).otherwise(state)

    return F.aggregate(arriving, F.struct(pending.alias("pending"), F.array().cast(f"array<{_JOB}>").alias("out")), step)


def scheduled(spark: SparkSession, blocks: DataFrame, slots: int, period: int) -> DataFrame:
    """_step, _source, _block, mix_slot of each block, from its release and deadline."""
    at, to = stage_path(spark, "windows"), stage_path(spark, "schedule")
    blocks = blocks.select(F.col("release"), F.struct("due", "_source", "_block").cast(_JOB).alias("job"), F.floor(F.col("release") / period).cast("int").alias("_step"))
    blocks.repartition("_step").write.partitionBy("_step").parquet(at)
    blocks = spark.read.schema(blocks.schema).parquet(at)
    steps = math.ceil(slots / period)
    kept = f"begun long, pending array<{_JOB}>, out array<{_JOB}>"
    for i in range(steps):
        here = blocks.filter(F.col("_step") == i).select((F.col("release") - i * period).alias("slot"), "job")
        every = spark.range(min(period, slots - i * period)).select(F.col("id").alias("slot"), F.lit(None).cast(_JOB).alias("job"))
        here = here.unionByName(every).groupBy("slot").agg(F.collect_list("job").alias("jobs")).agg(F.array_sort(F.collect_list(F.struct("slot", "jobs"))).alias("arriving"))
        if i:
            before = spark.read.schema(kept).parquet(f"{to}/_step={i - 1}").select((F.col("begun") + F.size("out")).alias("begun"), "pending")
        else:
            before = spark.range(1).select(F.lit(0).cast("long").alias("begun"), F.array().cast(f"array<{_JOB}>").alias("pending"))
        done = here.join(F.broadcast(before), F.lit(True)).select("begun", schedule(F.col("arriving"), F.col("pending")).alias("x"))  # one row
        # none is left in the end but for rounding
        out = F.concat("x.out", F.array_sort("x.pending")) if i == steps - 1 else F.col("x.out")
        done.select("begun", F.col("x.pending").alias("pending"), out.alias("out")).write.parquet(f"{to}/_step={i}")
    rows = spark.read.schema(f"{kept}, _step int").parquet(to) if steps else spark.createDataFrame([], f"{kept}, _step int")
    rows = rows.select("_step", "begun", F.posexplode("out").alias("_at", "job"))
    return rows.select("_step", "job._source", "job._block", (F.col("begun") + F.col("_at")).alias("mix_slot"))


def mix(docs: DataFrame, weights: DataFrame | None = None, *, source: str = "source", key: str = "doc_id", block_docs: int = BLOCK_DOCS, period: int = PERIOD) -> DataFrame:
    """docs with mix_slot (of its block) and mix_position (gapless from 0). weights: DataFrame (source, weight)."""
    spark = docs.sparkSession
    named = F.concat(F.when(F.col(source).isNull(), "0").otherwise("1"), F.coalesce(F.col(source).cast("string"), F.lit("")))
    counts = docs.groupBy(named.alias("_source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is not None:
        weights = weights.withColumn("source", F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce(F.col("source").cast("string"), F.lit(""))))
    blocks = _ceil_div(F.col("n"), F.lit(block_docs)).cast("long")
    plan = staged(shares(counts, weights).withColumn("blocks", blocks), "shares")
    known = plan.agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("rows"), F.sum("blocks").alias("slots")).first()
    if known["sources"] > MAX_SOURCES:
        raise ValueError(f"{known['sources']} sources; a mix states weights for at most {MAX_SOURCES}")
    slots = known["slots"] or 0
    jobs = staged(windows(plan, block_docs, slots), "blocks")
    table = scheduled(spark, jobs, slots, period).join(jobs.select("_source", "_block", "docs"), ["_source", "_block"])
    # documents before each block: those of earlier steps and of earlier slots in its own
    table = staged(table.withColumn("_first", F.sum("docs").over(Window.partitionBy("_step").orderBy("mix_slot")) - F.col("docs")), "slots")
    earlier = table.groupBy("_step").agg(F.sum("docs").alias("_sum"))
    earlier = earlier.select("_step", (F.sum("_sum").over(Window.orderBy("_step")) - F.col("_sum")).alias("_before"))  # a row a step
    table = table.join(F.broadcast(earlier), "_step").select("_source", "_block", F.col("mix_slot"), (F.col("_before") + F.col("_first")).alias("_start"))
    taken = [c for c in docs.columns if c not in ("mix_slot", "mix_position")]  # in a struct, so that no name clashes
    rows = ranked(docs.select(F.struct(*[F.col(f"`{c}`") for c in taken]).alias("_kept"), named.alias("_named"), F.col(key).alias("_key")), F.col("_named"), "_key", known["rows"] or 0)
    rows = rows.withColumn("_block", F.floor(F.col("_rank") / block_docs).cast("long")).join(table, ["_source", "_block"])
    position = F.col("_start") + F.col("_rank") % block_docs
    return rows.select("_kept.*", F.col("mix_slot").cast("long").alias("mix_slot"), position.cast("long").alias("mix_position"))


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows laid out by mix_position: ascending over partitions and within each."""
    return mixed.repartitionByRange(groups_for(mixed.sparkSession, 1, 1, 2), "mix_position").sortWithinPartitions("mix_position")


def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", "mix_slot", "mix_position")


QUERIES = {"op5_pfair_mix": op5_pfair_mix}
SQL: dict[str, str] = {}
