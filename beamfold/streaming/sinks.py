"""Stream runners: append to a table, statistics per interval, latest-wins outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from beamfold.operators.packets import latest_frame_sink, link_statistics
from beamfold.operators.raster import latest_snapshot
from beamfold.session import delete_folder, new_folder


def append_table(stream: DataFrame, path: str, *, checkpoint: str | None = None) -> StreamingQuery:
    """Process what is available into an append-only Parquet table, exactly once."""
    place = checkpoint or new_folder(stream.sparkSession, "stream")
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", place)
        .outputMode("append").trigger(availableNow=True).start())


def drain_table(stream: DataFrame, path: str, *, checkpoint: str | None = None) -> None:
    """Like ``append_table`` for a source that hands out its data by portions: micro-batches until nothing is left."""
    query = (
        stream.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint or new_folder(stream.sparkSession, "stream")).outputMode("append").start())
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def statistics_stream(outcomes: DataFrame, *, every: str = "5 seconds", delay: str = "10 seconds") -> DataFrame:
    """Counts per outcome and interval; an interval is final once the watermark passes it."""
    return link_statistics(outcomes.withWatermark("ts", delay), every=every)


def _per_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str | None, drain: bool) -> StreamingQuery:
    """drain: for a source that hands out its data by portions; the query has stopped when this returns."""
    place = checkpoint or new_folder(stream.sparkSession, "stream")
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", place)
    if not drain:
        return writer.trigger(availableNow=True).start()
    query = writer.start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return query


def latest_frames(stream: DataFrame, path: str, *, checkpoint: str | None = None, drain: bool = False) -> StreamingQuery:
    """Per micro-batch and session: send the newest waiting frame, count the displaced ones. What waits is what a micro-batch
    holds, so the source's portions decide it.

    Each batch owns its folder, so a repeated batch overwrites its own output only.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        kept, dropped = latest_frame_sink(batch)
        kept.join(dropped, "session_id").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _per_batch(stream, write, checkpoint, drain)


def latest_snapshots(stream: DataFrame, path: str, *, by: str = "scan_frame_index",
                     checkpoint: str | None = None, drain: bool = False) -> StreamingQuery:
    """Keep the newest snapshot per session: batch n merges version n-1 with its rows into version n. Version n-1 stays for a
    repeated batch n, older ones go."""
    def write(batch: DataFrame, batch_id: int) -> None:
        merged = batch
        if batch_id > 0:
            merged = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/version={batch_id - 1}"))
        latest_snapshot(merged, by=by).write.mode("overwrite").parquet(f"{path}/version={batch_id}")
        if batch_id > 1:
            delete_folder(batch.sparkSession, f"{path}/version={batch_id - 2}")

    return _per_batch(stream, write, checkpoint, drain)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version written by ``latest_snapshots``."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == newest).drop("version")
