"""Registry of queries with their DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its own name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def sql(name: str, spark_sql: str, duck: str | None = None) -> None:
    """Register SQL; tables are written in braces. ``duck`` is given where the dialects differ."""
    used = [t for t in TABLES if f"{{{t}}}" in spark_sql]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_sql, **{t: table(spark, sf_dir, t) for t in used})

    run.__name__ = name
    QUERIES[name] = run
    ORACLE[name] = re.sub(r"\{(\w+)\}", r"\1", duck or spark_sql).replace("{{", "{").replace("}}", "}")
