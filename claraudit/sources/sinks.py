"""Writers, and the reader's boundary: records that don't fit a schema become warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Data only; a summary is a table of its own."""
    df.write.option("header", True).csv(path)


def normalize_records(raw: DataFrame, schema: str, page_url: str) -> tuple[DataFrame, DataFrame]:
    """(records, warnings) of rows (page_url, body): bodies parsed by a schema; those that don't fit are warnings with
    their code and body. A missing page_url becomes the given one."""
    parsed = raw.withColumn("page_url", F.coalesce("page_url", F.lit(page_url))).withColumn("r", F.from_json("body", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    names = [f.name for f in parsed.schema["r"].dataType.fields if f.name != "_bad"]
    return parsed.filter(~bad).select("page_url", *[F.col(f"r.{n}").alias(n) for n in names]), parsed.filter(bad).select("page_url", F.lit("normalization_error").alias("code"), F.col("body").alias("message"))


def normalize_snapshot(raw: DataFrame, schemas: dict[str, str], page_url: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(records by bucket, all warnings) of rows (bucket, page_url, body): each bucket has a schema of its own, and bodies of a
    bucket without one are warnings."""
    out, warnings = {}, raw.filter(~F.col("bucket").isin(list(schemas)) | F.col("bucket").isNull()).select(F.coalesce("page_url", F.lit(page_url)).alias("page_url"), F.lit("unknown_bucket").alias("code"), F.col("body").alias("message"))
    for bucket, schema in schemas.items():
        out[bucket], bad = normalize_records(raw.filter(F.col("bucket") == bucket).select("page_url", "body"), schema, page_url)
        warnings = warnings.unionByName(bad)
    return out, warnings


def unseen_records(records: DataFrame, key: str = "element_ref_id", order: str = "chunk") -> DataFrame:
    """The first record of each reference id of a page."""
    return records.groupBy("page_url", key).agg(F.min_by(F.struct(*[c for c in records.columns if c not in ("page_url", key)]), order).alias("_r")).select("page_url", key, "_r.*")
