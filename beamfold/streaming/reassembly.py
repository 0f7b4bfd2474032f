"""Loss-tolerant reassembly of point packets with Structured Streaming state.

State is bounded by the receiver's own limits: at most ``max_inflight`` partial frames per
receiver, each at most ``max_points`` points. Capacity and eviction couple a receiver's frames, so
the receiver is the state key; a receiver is one socket, its rate bounded by one network link.
A receiver's share of one micro-batch is put into arrival order by runs on disk and its outcomes are handed
over in portions, so a worker's memory does not depend on the size of a micro-batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from beamfold.operators.packets import POINT_BYTES
from beamfold.streaming.arrival import in_order

OUTPUT = (
    "receiver string, outcome string, raster_frame_id long, timestamp_ns long, config_revision long, "
    "segment_count int, point_count long, arrival_ns long, body binary"
)
HEAD = ("timestamp_ns", "config_revision", "segment_count")
#: Outcomes, and bytes of completed bodies, that are handed over at a time.
OUT_ROWS, OUT_BYTES = 8192, 16 << 20


class Packet(NamedTuple):
    arrival_ns: int
    raster_frame_id: int
    timestamp_ns: int
    config_revision: int
    segment_count: int
    segment_index: int
    point_count: int
    body: bytes


PACKETS = pa.schema([pa.field(name, pa.binary() if name == "body" else pa.int64(), nullable=False) for name in Packet._fields])


class FrameAssembly(StatefulProcessor):
    """Partial frames of one receiver, advanced packet by packet in arrival order."""

    def __init__(self, timeout_ms: int, max_inflight: int, max_segments: int, max_points: int):
        self.timeout_ns = timeout_ms * 1_000_000
        self.max_inflight = max_inflight
        self.max_segments = max_segments
        self.max_points = max_points

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heads = handle.getMapState(
            "heads", "raster_frame_id long",
            "timestamp_ns long, config_revision long, segment_count int, updated_ns long, point_count long")
        self.parts = handle.getMapState("parts", "raster_frame_id long, segment_index int", "body binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frames = self._load()
        stored = {frame: set(parts) for frame, (_, parts) in frames.items()}
        out: list[tuple] = []
        size = 0
        for packets in in_order(rows, PACKETS, ["arrival_ns"]):
            for packet in map(Packet._make, zip(*(column.to_numpy().tolist() for column in packets.columns))):
                seen = len(out)
                self._advance(frames, packet, out)
                size += sum(len(event[-1] or b"") for event in out[seen:])
                if len(out) >= OUT_ROWS or size >= OUT_BYTES:
                    yield self._rows(key[0], out)
                    out, size = [], 0
        self._store(frames, stored)
        self._rearm(frames)
        yield self._rows(key[0], out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        frames = self._load()
        stored = {frame: set(parts) for frame, (_, parts) in frames.items()}
        out: list[tuple] = []
        self._expire(frames, expiredTimerInfo.getExpiryTimeInMs() * 1_000_000, out)
        self._store(frames, stored)
        self._rearm(frames)
        yield self._rows(key[0], out)

    def close(self) -> None:
        pass

    def _load(self) -> dict[int, tuple[dict, dict]]:
        names = (*HEAD, "updated_ns", "point_count")
        frames = {frame[0]: (dict(zip(names, head)), {}) for frame, head in self.heads.iterator()}
        for (frame, segment), (body,) in self.parts.iterator():
            frames[frame][1][segment] = body
        return frames

    def _store(self, frames: dict, stored: dict[int, set[int]]) -> None:
        """Write back only what changed; a frame's stored segments never change in place."""
        for frame, segments in stored.items():
            kept = frames[frame][1] if frame in frames else {}
            for segment in segments - set(kept):
                self.parts.removeKey((frame, segment))
            if frame not in frames:
                self.heads.removeKey((frame,))
        for frame, (head, parts) in frames.items():
            self.heads.updateValue(
                (frame,), tuple(head[n] for n in (*HEAD, "updated_ns", "point_count")))
            renewed = head.pop("renewed", False)
            for segment, body in parts.items():
                if renewed or segment not in stored.get(frame, ()):
                    self.parts.updateValue((frame, segment), (body,))

    def _rearm(self, frames: dict) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if frames:
            soonest = min(head["updated_ns"] for head, _ in frames.values()) + self.timeout_ns
            self.handle.registerTimer(-(-soonest // 1_000_000))

    def _expire(self, frames: dict, now: int, out: list) -> None:
        for frame in [f for f, (head, _) in frames.items() if now - head["updated_ns"] >= self.timeout_ns]:
            out.append(self._event("expired", frame, frames.pop(frame)[0], now))

    def _advance(self, frames: dict, packet: Packet, out: list) -> None:
        now, frame = packet.arrival_ns, packet.raster_frame_id
        self._expire(frames, now, out)
        incoming = {n: getattr(packet, n) for n in HEAD}
        size, segment, body = packet.point_count, packet.segment_index, packet.body
        total = incoming["segment_count"]
        if not (0 < total <= self.max_segments and 0 <= segment < total and len(body) == size * POINT_BYTES):
            out.append(self._event("bad_layout", frame, {**incoming, "point_count": size}, now))
            return
        if frame in frames and any(frames[frame][0][n] != incoming[n] for n in HEAD):
            out.append(self._event("inconsistent", frame, frames.pop(frame)[0], now))
        if frame not in frames:
            if len(frames) >= self.max_inflight:
                oldest = min(frames, key=lambda f: (frames[f][0]["updated_ns"], f))
                out.append(self._event("evicted", oldest, frames.pop(oldest)[0], now))
            frames[frame] = ({**incoming, "updated_ns": now, "point_count": 0, "renewed": True}, {})
        head, parts = frames[frame]
        # A packet that is late within the watermark does not shorten the frame's life.
        head["updated_ns"] = max(head["updated_ns"], now)
        if segment in parts:
            out.append(self._event("duplicate", frame, head, now))
        elif head["point_count"] + size > self.max_points:
            out.append(self._event("oversized", frame, frames.pop(frame)[0], now))
        else:
            head["point_count"] += size
            parts[segment] = body
            if len(parts) == total:
                frames.pop(frame)
                out.append(self._event("completed", frame, head, now, b"".join(parts[i] for i in range(total))))

    @staticmethod
    def _event(outcome: str, frame: int, head: dict, now: int, body: bytes | None = None) -> tuple:
        return (outcome, frame, *(head[n] for n in HEAD), head["point_count"], now, body)

    @staticmethod
    def _rows(receiver: str, out: list) -> pd.DataFrame:
        names = ["outcome", "raster_frame_id", *HEAD, "point_count", "arrival_ns", "body"]
        rows = pd.DataFrame(out, columns=names)
        rows.insert(0, "receiver", receiver)
        return rows


def reassemble_stream(packets: DataFrame, *, timeout_ms: int = 500, max_inflight: int = 8, max_segments: int = 4096,
                      max_points: int = 2_000_000, delay: str = "5 seconds") -> DataFrame:
    """Completed frames and every other outcome of a packet stream, one row each.

    Packets: receiver, arrival_ns, the packet header columns, and ``body`` (raw point bytes).
    Arrival is the event time: idle frames expire by the next packet, or by the watermark when
    none comes. ``delay`` is how late a packet may be delivered behind the newest one and still
    count. Needs the RocksDB state store (``use_rocksdb``).
    """
    if min(timeout_ms, max_inflight, max_segments, max_points) <= 0:
        raise ValueError("limits must be positive")
    stamped = packets.withColumn(
        "arrival_ts", F.timestamp_micros(F.floor(F.col("arrival_ns") / 1000).cast("long")))
    return (
        stamped.withWatermark("arrival_ts", delay).groupBy("receiver")
        .transformWithStateInPandas(
            FrameAssembly(timeout_ms, max_inflight, max_segments, max_points),
            outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
    )


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
