"""Where queries and their SQL are registered, and how results are rounded."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DIGITS = 7


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to DIGITS places, and no negative zero, as sums in another order differ in the last bits."""
    return df.select(*((F.round(F.col(n), DIGITS) + F.lit(0.0)).alias(n) if t == "double" else F.col(n).cast("long").alias(n) if t in ("int", "bigint", "tinyint", "smallint") else F.col(n)
        for n, t in df.dtypes))


def add(name: str, sql: str | None, query: Query) -> None:
    QUERIES[name] = lambda spark, d: rounded(query(spark, d))
    if sql:
        SQL[name] = re.sub(r"\bat\b", '"at"', sql)  # a keyword there


def r(*names: str) -> str:
    return ", ".join(f"round(({e})::DOUBLE, {DIGITS}) + 0.0 AS {n}" for e, n in (x.rsplit(" AS ", 1) if " AS " in x else (x, x) for x in names))
