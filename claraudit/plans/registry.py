"""How a plan module registers queries, and records made by arithmetic from a table's keys."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Registry:
    """QUERIES and SQL of a module."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable:
        def take(f: Callable) -> Callable:
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return take


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def appended(spark: SparkSession, sf_dir: str, *parts: str | tuple[str, str]) -> DataFrame:
    """Pages with parts behind their markup. A part is markup or (condition, markup); {sql} in it becomes that value."""
    pieces = [F.col("html")]
    for part in parts:
        condition, markup = part if isinstance(part, tuple) else (None, part)
        chunks = re.split(r"(?s)\{\{(.*?)\}\}", markup)
        piece = F.concat(*[F.lit(x) if i % 2 == 0 else F.expr(f"cast({x} as string)") for i, x in enumerate(chunks)])
        pieces.append(piece if condition is None else F.when(F.expr(condition), piece).otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.concat(*pieces).alias("html"))


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


class Records:
    """Records whose columns run through all combinations of stated values as a table's key counts up: a truth table, as
    often as the table is long. The same values make the records in Spark (frame) and in SQL (cte)."""

    def __init__(self, source: str, key: str, /, **values: list):
        self.source, self.key, self.values = source, key, values

    def _steps(self):
        d = 1
        for name, vs in self.values.items():
            yield name, vs, d
            d *= len(vs)

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, self.source).select(F.col(self.key).alias("k"))
        return rows.select("k", *[self._column(vs, d).alias(n) for n, vs, d in self._steps()])

    @staticmethod
    def _column(values: list, d: int) -> Column:
        kind = next(("boolean" if isinstance(v, bool) else "double" if isinstance(v, float) else "bigint" if isinstance(v, int) else "string" for v in values if v is not None), "string")
        place = (F.floor(F.col("k") / d) % len(values) + 1).cast("int")
        return F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), place)

    def cte(self) -> str:
        cols = ", ".join(f"list_extract([{', '.join(map(_literal, vs))}], CAST((k // {d}) % {len(vs)} + 1 AS BIGINT)) AS {n}" for n, vs, d in self._steps())
        return f"SELECT k, {cols} FROM (SELECT {self.key} AS k FROM {self.source})"
