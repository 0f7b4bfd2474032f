"""Order-dependent primitives that never put a whole key into one task.

A plain ``Window.partitionBy(session).orderBy(seq)`` sorts each session in one task, and one
session may hold a third of all rows.  Here a series is cut into chunks of a fixed span of
its leading order column.  Windows run per (key, chunk); the state that crosses a chunk edge
(last row, running total, last non-null value) is carried by a summary of one row per chunk.
The summary is thousands of times smaller than the data, so its per-key window is cheap, and
Spark picks broadcast or shuffle for the join back by its measured size.

Each primitive reads its input twice (summary and rows). Operators that chain several of them
therefore work on the few columns they need and ``stage`` them in between, so the cost stays linear.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = "_chunk"


@dataclass(frozen=True)
class Series:
    """Rows of ``keys`` ordered by ``order``.

    ``order[0]`` must be an integer column; ``span`` is how many of its units one chunk covers,
    so choose it to hold a task-sized number of rows. ``order`` must be unique per key.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    span: int = 1 << 17

    @property
    def chunk_keys(self) -> list[str]:
        return [*self.keys, CHUNK]

    def window(self) -> Window:
        return Window.partitionBy(*self.chunk_keys).orderBy(*self.order)

    def summary_window(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy(CHUNK)


def chunked(df: DataFrame, series: Series) -> DataFrame:
    if CHUNK in df.columns:
        return df
    return df.withColumn(CHUNK, F.floor(F.col(series.order[0]) / F.lit(series.span)).cast("long"))


def _sort_key(series: Series) -> Column:
    return F.struct(*[F.col(c) for c in series.order])


def _attach(df: DataFrame, summary: DataFrame, series: Series) -> DataFrame:
    return df.join(summary, series.chunk_keys, "left")


def _neighbour(df: DataFrame, series: Series, columns: Mapping[str, str], forward: bool) -> DataFrame:
    df = chunked(df, series)
    packed = F.struct(*[F.col(source).alias(name) for name, source in columns.items()])
    pick, shift = (F.min_by, F.lead) if forward else (F.max_by, F.lag)
    summary = (
        df.groupBy(*series.chunk_keys).agg(pick(packed, _sort_key(series)).alias("_edge"))
        .withColumn("_carry", shift("_edge").over(series.summary_window())).drop("_edge")
    )
    joined = _attach(df, summary, series)
    inside = shift(packed).over(series.window())
    joined = joined.withColumn("_near", F.coalesce(inside, F.col("_carry")))
    return joined.select(*df.columns, *[F.col("_near")[name].alias(name) for name in columns]).drop(CHUNK)


def previous(df: DataFrame, series: Series, columns: Mapping[str, str]) -> DataFrame:
    """Add ``new`` = the preceding row's ``source`` for each ``{new: source}``; NULL on the first row."""
    return _neighbour(df, series, columns, forward=False)


def following(df: DataFrame, series: Series, columns: Mapping[str, str]) -> DataFrame:
    """Add ``new`` = the next row's ``source`` for each ``{new: source}``; NULL on the last row."""
    return _neighbour(df, series, columns, forward=True)


def running_sum(df: DataFrame, series: Series, columns: Mapping[str, Column], *, inclusive: bool = True) -> DataFrame:
    """Add running totals (including the current row unless ``inclusive`` is off)."""
    df = chunked(df, series)
    prepared = df.select("*", *[value.alias(f"_v_{name}") for name, value in columns.items()])
    before = series.summary_window().rowsBetween(Window.unboundedPreceding, -1)
    summary = prepared.groupBy(*series.chunk_keys).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in columns])
    summary = summary.select(
        *series.chunk_keys, *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in columns]
    )
    end = Window.currentRow if inclusive else -1
    inside = series.window().rowsBetween(Window.unboundedPreceding, end)
    joined = _attach(prepared, summary, series)
    totals = [
        (F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) + F.col(f"_b_{n}")).alias(n) for n in columns
    ]
    return joined.select(*df.columns, *totals).drop(CHUNK)


def row_index(df: DataFrame, series: Series, name: str, *, total: str | None = None) -> DataFrame:
    """Add the zero-based position of each row in its series, and optionally the series' row count."""
    df = chunked(df, series)
    everything = Window.partitionBy(*series.keys)
    summary = df.groupBy(*series.chunk_keys).agg(F.count(F.lit(1)).alias("_n"))
    before = series.summary_window().rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_n").over(everything).alias(total)] if total else []
    summary = summary.select(
        *series.chunk_keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"), *extra
    )
    joined = _attach(df, summary, series)
    position = (F.row_number().over(series.window()).cast("long") - 1 + F.col("_b")).alias(name)
    return joined.select(*df.columns, position, *([F.col(total)] if total else [])).drop(CHUNK)


def carry_forward(df: DataFrame, series: Series, columns: Mapping[str, Column]) -> DataFrame:
    """Add the last non-NULL value at or before each row."""
    df = chunked(df, series)
    prepared = df.select("*", *[value.alias(f"_v_{name}") for name, value in columns.items()])
    summary = prepared.groupBy(*series.chunk_keys).agg(
        *[
            F.max_by(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), _sort_key(series))).alias(f"_l_{n}")
            for n in columns
        ]
    )
    before = series.summary_window().rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        *series.chunk_keys, *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in columns]
    )
    inside = series.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = _attach(prepared, summary, series)
    values = [
        F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(inside), F.col(f"_b_{n}")).alias(n) for n in columns
    ]
    return joined.select(*df.columns, *values).drop(CHUNK)


def rows_since(df: DataFrame, series: Series, columns: Mapping[str, Column]) -> DataFrame:
    """Add how many rows ago each flag last held (0 on a flagged row); NULL before the first one."""
    df = chunked(df, series)
    prepared = df.select("*", *[value.alias(f"_f_{name}") for name, value in columns.items()])
    prepared = prepared.withColumn("_rn", F.row_number().over(series.window()).cast("long"))
    summary = prepared.groupBy(*series.chunk_keys).agg(
        F.max("_rn").alias("_n"), *[F.max(F.when(F.col(f"_f_{n}"), F.col("_rn"))).alias(f"_p_{n}") for n in columns])
    before = series.summary_window().rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    summary = summary.select(*series.chunk_keys, "_base", *[
        F.max(F.col("_base") + F.col(f"_p_{n}")).over(before).alias(f"_g_{n}") for n in columns])
    joined = _attach(prepared, summary, series)
    inside = series.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.col("_base") + F.col("_rn")
    values = [
        (here - F.coalesce(F.col("_base") + F.max(F.when(F.col(f"_f_{n}"), F.col("_rn"))).over(inside),
                           F.col(f"_g_{n}"))).alias(n)
        for n in columns
    ]
    return joined.select(*df.columns, *values).drop(CHUNK)


def ordinal(df: DataFrame, keys: Sequence[str], value: str, name: str, *, span: int = 1 << 17) -> DataFrame:
    """Add the zero-based dense rank of integer ``value`` within ``keys``.

    Ranks are taken over the distinct values (map-side combined) and joined back, so equal
    values never gather in one task.
    """
    distinct = df.select(*keys, value).distinct()
    ranked = row_index(distinct, Series(tuple(keys), (value,), span), name)
    return df.join(ranked, [*keys, value], "left")
