"""Structural joins on the intervals of elements: y lies in x where x.pos < y.pos <= x.last. Intervals of a page are nested
or apart, so windows in document order tell what is around an element, however deep, without walking up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inside(of: Column, *keys: str) -> Column:
    """Whether a row lies in one where `of` holds: one of those before it reaches as far."""
    before = Window.partitionBy(*keys).orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(of, F.col("last"))).over(before) >= F.col("pos"), F.lit(False))


def nearest(els: DataFrame, of: Column, name: str, *keys: str) -> DataFrame:
    """Adds the position of the nearest element around each where `of` holds, null if there is none. As many of them are
    open at an element as have begun and not ended; the innermost is the last one that began at that nesting."""
    keys = keys or ("page_id",)
    rows = els.withColumn("_of", F.coalesce(of, F.lit(False)))
    starts = rows.select(*keys, F.col("pos").alias("_at"), F.lit(1).alias("_turn"), F.lit(0).alias("_step"), F.struct("*").alias("_row"))
    ends = rows.filter("_of").select(*keys, (F.col("last") + 1).alias("_at"), F.lit(0).alias("_turn"), F.lit(-1).alias("_step"), F.lit(None).cast(starts.schema["_row"].dataType).alias("_row"))
    order = Window.partitionBy(*keys).orderBy("_at", "_turn")
    events = starts.withColumn("_step", F.col("_row._of").cast("int")).unionByName(ends)
    # _step of an element counts from the next one on
    events = events.withColumn("_open", F.sum("_step").over(order) - F.when(F.col("_row").isNotNull(), F.col("_step")).otherwise(0)).filter("_row is not null")
    # an element of the kind begins the nesting behind the one it lies in: it answers at _open + 1 and asks at _open
    asks = events.select(*keys, F.col("_open").alias("_nesting"), F.col("_at"), F.lit(1).alias("_turn"), F.lit(None).cast("int").alias("_own"), "_row")
    own = events.filter("_row._of").select(*keys, (F.col("_open") + 1).alias("_nesting"), F.col("_at"), F.lit(0).alias("_turn"), F.col("_at").alias("_own"), F.lit(None).cast(starts.schema["_row"].dataType).alias("_row"))
    last = F.last("_own", ignorenulls=True).over(Window.partitionBy(*keys, "_nesting").orderBy("_at", "_turn"))
    found = F.when(F.col("_nesting") > 0, last).alias(name)
    out = asks.unionByName(own).select(found, "_row").filter("_row is not null")
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in els.columns], name)


def with_of(rows: DataFrame, at: str, els: DataFrame, *fields: Column) -> DataFrame:
    """Adds fields of the element at position `at` of the same page."""
    there = els.select(F.col("page_id").alias("_page"), F.col("pos").alias("_pos"), *fields)
    return rows.join(there, (F.col("page_id") == F.col("_page")) & (F.col(at) == F.col("_pos")), "left").drop("_page", "_pos")
