"""Registry of this subpackage's queries and the SQL that states their rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MODULES = ("quality", "decontaminate", "licenses", "neardup", "pieces", "tokens", "secrets", "toxicity", "repeats", "toolcalls", "collocations", "merkle", "packing")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"{__package__}.{name}")


def column(name: str) -> Column:
    """A column by its name as it is, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
