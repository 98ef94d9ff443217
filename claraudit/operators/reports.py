"""Report aggregates over findings and records. All are one aggregation with map-side combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low")


def status_counts() -> list[Column]:
    return [F.count_if(F.col("status") == "fail").alias("violations"), F.count_if(F.col("status") == "needs_review").alias("needs_review"), F.count_if(~F.col("status").isin("fail", "needs_review")).alias("passes")]


def summary(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count(F.lit(1)).alias("total_findings"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("fail", "violations"), ("needs_review", "needs_review"), ("pass", "passes"))])


def by_severity(findings: DataFrame) -> DataFrame:
    """The four severities, zero where there are none, over what isn't a pass."""
    counted = findings.filter(F.col("status").isin("fail", "needs_review") & F.col("severity").isin(*SEVERITIES)).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    domain = findings.sparkSession.sql(f"SELECT explode(array({', '.join(repr(s) for s in SEVERITIES)})) AS severity")
    return domain.join(counted, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("n"))


def by_dimensions(findings: DataFrame, *dims: str) -> DataFrame:
    """dimension, value and status counts of several independent groupings in one scan (grouping sets)."""
    named = findings.select("status", *[F.coalesce(F.when(F.col(d) != "", F.col(d)), F.lit("unknown")).alias(d) for d in dims])
    sets = named.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims])
    out = sets.agg(*status_counts(), *[F.grouping(d).alias(f"_{d}") for d in dims])
    which = F.coalesce(*[F.when(F.col(f"_{d}") == 0, F.lit(d)) for d in dims])
    return out.select(which.alias("dimension"), F.coalesce(*[F.when(F.col(f"_{d}") == 0, F.col(d)) for d in dims]).alias("value"), "violations", "needs_review", "passes")


def by_one(findings: DataFrame, dim: str) -> DataFrame:
    return by_dimensions(findings, dim).drop("dimension").withColumnRenamed("value", dim)


def top_criteria(findings: DataFrame, k: int = 8) -> DataFrame:
    """The k criteria with the most failures."""
    return findings.filter("status = 'fail'").groupBy("wcag_sc").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "wcag_sc").limit(k)


def samples(rows: DataFrame, by: str, value: str, order: str, n: int = 3) -> DataFrame:
    """Count of each group and its first n non-empty values. Only n values of a group ever travel: a first selection is made
    in each of 32 parts of it."""
    part = F.pmod(F.xxhash64(order), F.lit(32))
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("count"))
    filled = rows.filter(F.coalesce(F.col(value), F.lit("")) != "").withColumn("_part", part)
    for keys in ((by, "_part"), (by,)):
        w = Window.partitionBy(*keys).orderBy(order)
        filled = filled.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
    taken = filled.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "|").alias("samples"))
    return counts.join(taken, by, "left").select(by, "count", F.coalesce("samples", F.lit("")).alias("samples"))


def status_summary(records: DataFrame, *by: str, checked: tuple[str, ...] = ("PASSED", "FAILED")) -> DataFrame:
    """Totals, checked and each status of records with a status column."""
    return records.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin(*checked)).alias("checked"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("PASSED", "passed"), ("FAILED", "failed"), ("NEEDS_REVIEW", "needs_review"), ("N/A", "not_applicable"))])


def pass_rate(passed: Column, total: Column) -> Column:
    """Percent with one decimal; 0 for nothing."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(passed * 100.0 / total, 1))
