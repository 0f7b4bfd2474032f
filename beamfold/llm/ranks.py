"""Places of rows in an order, without one task for a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from beamfold.session import stage


def _count(group: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            # Rows of a group stand together: places count on from the last batch, and anew where a group begins.
            runs = pa.compute.run_end_encode(batch.column(group))
            ends = np.array(runs.run_ends.to_pylist())
            values = runs.values.to_pylist()
            begins = np.concatenate([[0], ends[:-1]])
            carry = np.zeros(len(ends), np.int64)
            if values[0] == last:
                carry[0] = n
            within = np.arange(size) - np.repeat(begins - carry, ends - begins)
            last, n = values[-1], int(within[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(size, part, np.int32)), pa.array(within)], [*batch.schema.names, "part", "within"])

    return run


def places(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with ``place``: the row's place (from 0) within its group under ``order``; group is a column without nulls.

    Rows are dealt by ranges of (group, order), so that a group of any size spreads over many tasks; each task counts its own
    rows, and only one row per task and group is summed over. Written once as a table.
    """
    keys = [group, *order]
    schema = StructType(list(df.schema.fields)).add("part", IntegerType()).add("within", LongType())
    counted = stage(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_count(group), schema), name)
    before = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.groupBy("part", group).count().select("part", group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    # A range has one row per group in it: at most as many rows as tasks and groups, so the join may well be a broadcast by size.
    return counted.join(bases, ["part", group]).withColumn("place", F.col("base") + F.col("within")).drop("part", "within", "base")
