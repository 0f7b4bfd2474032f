"""Recordings served again as a stream, and the data source for it: folders of Parquet files, ``tick=0``, ``tick=1``, ... in order."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from beamfold.functions.kernels import pack_samples, unpack_samples
from beamfold.operators.ordered import Series, running_sum
from beamfold.schemas import FULL_CHIRP_PERIOD, PACKED_ASCANS
from beamfold.session import stage

RESTAMPED = ("frame_id", "dma_buffer_sequence", "record_index_in_buffer", "records_in_buffer")


def renumber(ascans: DataFrame, *, loops: int = 1, records_per_buffer: int | None = None, span: int = 1 << 17) -> DataFrame:
    """Frames from 1 and buffers from 0 per session, record index, count and trigger sequence restamped, ``loops`` times over.

    Stored buffers stay as they are; ``records_per_buffer`` cuts the records anew instead, as recordings of single records
    need it. A buffer may then begin in one loop and end in the next.
    """
    if records_per_buffer is not None and records_per_buffer < 1:
        raise ValueError("records_per_buffer must be positive")
    # Numbering needs buffer sizes only; the samples move once, for the rank inside their buffer.
    buffers = stage(ascans.groupBy("session_id", "dma_buffer_sequence").agg(F.count(F.lit(1)).alias("_size")), "buffers")
    series = Series(("session_id",), ("dma_buffer_sequence",), span)
    numbered = running_sum(buffers, series, {"_first": F.col("_size"), "_b": F.lit(1)}, inclusive=False)
    totals = buffers.groupBy("session_id").agg(F.sum("_size").alias("_records"), F.count(F.lit(1)).alias("_buffers"))
    heads = numbered.join(totals, "session_id")
    buffer = Window.partitionBy("session_id", "dma_buffer_sequence").orderBy("record_index_in_buffer")
    rows = ascans.join(heads, ["session_id", "dma_buffer_sequence"]).withColumn("_i", F.row_number().over(buffer) - 1)
    rows = rows.withColumn("_loop", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(loops - 1).cast("long"))))
    place = F.col("_first") + F.col("_i") + F.col("_loop") * F.col("_records")
    if records_per_buffer is None:
        sequence, index, size = F.col("_b") + F.col("_loop") * F.col("_buffers"), F.col("_i"), F.col("_size")
    else:
        k = F.lit(records_per_buffer).cast("long")
        index = place % k
        sequence, size = (place - index) / k, F.least(k, F.col("_records") * loops - (place - index))
    stamps = {"frame_id": (place + 1).cast("long"), "dma_buffer_sequence": sequence.cast("long"),
              "record_index_in_buffer": index.cast("int"), "records_in_buffer": size.cast("int")}
    if "trigger" in ascans.columns:
        stamps["trigger"] = F.col("trigger").withField("sequence", stamps["frame_id"])
    return rows.select(*[c for c in ascans.columns if c not in stamps], *[v.alias(c) for c, v in stamps.items()])


def publish_replay(ascans: DataFrame, path: str, *, loops: int = 1, buffers_per_tick: int = 200, records_per_buffer: int | None = None) -> None:
    """Write the renumbered recording for ``replay_stream``: packed rows, one folder per tick of whole buffers."""
    numbered = renumber(ascans, loops=loops, records_per_buffer=records_per_buffer)
    if "payload" not in numbered.columns:
        numbered = numbered.withColumn("payload", pack_samples(F.col("samples")))
    if "frame_kind" not in numbered.columns:
        numbered = numbered.withColumn("frame_kind", F.lit(FULL_CHIRP_PERIOD))
    columns = [f.name for f in PACKED_ASCANS if f.name in numbered.columns]
    tick = F.floor(F.col("dma_buffer_sequence") / buffers_per_tick).cast("long")
    (
        numbered.select(*columns, tick.alias("tick")).repartition("session_id", "tick")
        .sortWithinPartitions("session_id", "tick", "dma_buffer_sequence", "record_index_in_buffer")
        .write.partitionBy("tick").parquet(path)
    )


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    uri = re.sub(r"^s3[an]:", "s3:", path) if "://" in path else "file://" + (path[5:] if path.startswith("file:") else path)
    return pafs.FileSystem.from_uri(uri)


@dataclass
class TickFile(InputPartition):
    file: str


class TickReader(DataSourceStreamReader):
    """Ticks in ascending order. An offset is the number of the next tick, so a restarted query goes on where it stopped."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.rate, self.first = int(options.get("ticksPerTrigger", "1")), int(options.get("firstTick", "0"))
        self.next = self.first

    def _ticks(self) -> dict[int, str]:
        system, root = _files(self.path)
        found = (re.fullmatch(r"tick=(\d+)", info.base_name) for info in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)))
        return {int(m[1]): f"{root}/{m[0]}" for m in found if m}

    def initialOffset(self) -> dict:
        return {"tick": self.first}

    def latestOffset(self) -> dict:
        last = max(self._ticks(), default=-1)
        return {"tick": max(self.next, min(self.next + self.rate, last + 1))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        # Spark names the last offset here after a restart, too.
        self.next = max(self.next, end["tick"])
        system, ticks = _files(self.path)[0], self._ticks()
        return [TickFile(info.path) for tick in range(start["tick"], end["tick"]) if tick in ticks
                for info in sorted(system.get_file_info(pafs.FileSelector(ticks[tick])), key=lambda i: i.path) if info.path.endswith(".parquet")]

    def read(self, partition: TickFile) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        with _files(self.path)[0].open_input_file(partition.file) as raw:
            for batch in pq.ParquetFile(raw).iter_batches(batch_size=256):
                table = pa.Table.from_batches([batch])
                columns = [table[f.name].cast(f.type) if f.name in table.column_names else pa.nulls(len(table), f.type) for f in schema]
                yield from pa.Table.from_arrays(columns, schema=schema).to_batches()

    def commit(self, end: dict) -> None:
        pass


class TickSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "beamfold_ticks"

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.options["schema"]))

    def streamReader(self, schema: StructType) -> TickReader:
        return TickReader(schema, self.options)


def tick_stream(spark: SparkSession, path: str, schema: StructType, *, ticks_per_trigger: int = 1, first_tick: int = 0) -> DataFrame:
    """A table written in folders by tick as a stream: ticks arrive in their order, at most ``ticks_per_trigger`` a micro-batch, from
    ``first_tick`` on or from where a query's checkpoint stands. Columns that a file lacks are NULL."""
    spark.dataSource.register(TickSource)
    return (
        spark.readStream.format("beamfold_ticks").option("path", path).option("schema", schema.json())
        .option("ticksPerTrigger", ticks_per_trigger).option("firstTick", first_tick).load())


def replay_stream(spark: SparkSession, path: str, *, ticks_per_trigger: int = 1, first_tick: int = 0, unpack: bool = True) -> DataFrame:
    """A published replay as a stream (``tick_stream``). Rows carry ``samples``, or ``payload`` unless ``unpack``."""
    rows = tick_stream(spark, path, PACKED_ASCANS, ticks_per_trigger=ticks_per_trigger, first_tick=first_tick)
    return rows.withColumn("samples", unpack_samples(F.col("payload"))).drop("payload") if unpack else rows
