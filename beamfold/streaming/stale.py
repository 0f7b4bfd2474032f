"""The stale-frame filter as a stream: two numbers of state per sender, its share of a micro-batch in order and in portions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from beamfold.streaming.arrival import in_order

ORDER = ["arrival_ns", "raster_frame_id"]
FRAMES = pa.schema([(name, pa.int64()) for name in ORDER])
OUTPUT = "sender string, raster_frame_id long, arrival_ns long, stale boolean"


class LastAccepted(StatefulProcessor):
    def __init__(self, reset_s: float):
        self.reset_ns = int(reset_s * 1e9)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "raster_frame_id long, arrival_ns long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = tuple(self.last.get()) if self.last.exists() else None
        for frames in in_order(rows, FRAMES, ORDER):
            arrivals, numbers = (frames[name].to_numpy() for name in ORDER)
            verdicts = []
            for now, frame in zip(arrivals.tolist(), numbers.tolist()):
                fresh = last is None or frame > last[0] or now - last[1] >= self.reset_ns
                last = (frame, now) if fresh else last
                verdicts.append(not fresh)
            yield pd.DataFrame({"sender": key[0], "raster_frame_id": numbers, "arrival_ns": arrivals, "stale": verdicts})
        self.last.update(last)

    def close(self) -> None:
        pass


def drop_stale_stream(frames: DataFrame, *, reset_s: float = 2.0, keep_stale: bool = False) -> DataFrame:
    """Streaming twin of ``drop_stale_frames``; rows: sender, raster_frame_id, arrival_ns."""
    marked = frames.select("sender", "raster_frame_id", "arrival_ns").groupBy("sender").transformWithStateInPandas(
        LastAccepted(reset_s), outputStructType=OUTPUT, outputMode="Append", timeMode="None")
    return marked if keep_stale else marked.where("not stale").drop("stale")
