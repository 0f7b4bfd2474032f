"""Point packets: chunking, decoding, batch reassembly, stale filter, link statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from beamfold.operators.records import first_reason, split_by_reason
from beamfold.schemas import PACKET_POINT

# Fixed values of packet format 2.
MAGIC = b"FMCW"
VERSION = 2
HEADER_BYTES = 40
POINT_BYTES = 20
MAXIMUM_POINTS_PER_PACKET = 3273
MAXIMUM_SEGMENTS = 65535
FRAME_KEYS = ["sender", "raster_frame_id", "timestamp_ns", "config_revision", "segment_count"]


def packetize(frames: DataFrame, *, points_per_packet: int = 256) -> tuple[DataFrame, DataFrame]:
    """Cut each frame's points into segments, in-row (no shuffle): (packets, rejects). An empty frame is one empty segment.

    ``rejects`` lists, without their points, the frames that would need more than 65535 segments (``segment_count``) and those
    without a list of points (``points``).
    """
    if not 1 <= points_per_packet <= MAXIMUM_POINTS_PER_PACKET:
        raise ValueError("points_per_packet is outside the packet format's range")
    tagged = _with_segment_count(frames, points_per_packet).withColumn("reject_reason", first_reason([
        (F.col("points").isNotNull(), "points"), (F.col("segment_count") <= MAXIMUM_SEGMENTS, "segment_count")]))
    good, bad = split_by_reason(tagged)
    kept = [c for c in good.columns if c != "points"]
    rows = good.select(
        *kept, "points", F.explode(F.sequence(F.lit(0), F.col("segment_count") - 1)).alias("segment_index"))
    part = F.slice("points", F.col("segment_index") * points_per_packet + 1, F.lit(points_per_packet))
    packets = rows.select(*kept, "segment_index", part.alias("points")).withColumn("point_count", F.size("points"))
    return packets, bad.withColumn("points_in_frame", F.size("points")).drop("points")


def _with_segment_count(frames: DataFrame, points_per_packet: int) -> DataFrame:
    count = F.greatest(F.ceil(F.size("points") / F.lit(float(points_per_packet))), F.lit(1)).cast("int")
    return frames.withColumn("segment_count", count)


HEADER_DTYPE = np.dtype([
    ("magic", "S4"), ("version", "<u2"), ("header_bytes", "<u2"), ("raster_frame_id", "<i8"), ("timestamp_ns", "<i8"),
    ("config_revision", "<i8"), ("segment_count", "<u2"), ("segment_index", "<u2"), ("point_count", "<u2"),
    ("point_stride", "<u2"),
])
WIDE_FIELDS = ("raster_frame_id", "timestamp_ns", "config_revision")
HEADER_SCHEMA = T.StructType([
    T.StructField(n, T.LongType() if n in WIDE_FIELDS else T.IntegerType()) for n in HEADER_DTYPE.names if n != "magic"
])


@F.arrow_udf(HEADER_SCHEMA)
def _decode_headers(heads: pa.Array) -> pa.Array:
    """Header fields of 40-byte prefixes, one buffer view per batch; unsigned values past 2^63 turn negative."""
    heads = heads.cast(pa.binary(HEADER_BYTES))
    raw = np.frombuffer(heads.buffers()[1], np.uint8, count=len(heads) * HEADER_BYTES, offset=heads.offset * HEADER_BYTES)
    rows = raw.view(HEADER_DTYPE)
    columns = [
        pa.array(rows[n].astype(np.int64 if n in WIDE_FIELDS else np.int32)) for n in HEADER_SCHEMA.fieldNames()]
    return pa.StructArray.from_arrays(columns, names=HEADER_SCHEMA.fieldNames())


@F.arrow_udf(T.ArrayType(PACKET_POINT))
def _decode_points(body: pa.Array) -> pa.Array:
    body = body.cast(pa.binary())
    _, offsets_buffer, data = body.buffers()
    offsets = np.frombuffer(offsets_buffer, dtype=np.int32)[body.offset:body.offset + len(body) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.empty(0, np.uint8)
    values = raw.view("<f4").reshape(-1, 5)
    struct = pa.StructArray.from_arrays(
        [pa.array(np.ascontiguousarray(values[:, i])) for i in range(5)], names=PACKET_POINT.fieldNames())
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]) // POINT_BYTES, pa.int32()), struct)


def decode_body(body: Column) -> Column:
    """Raw point bytes to an array of point structs."""
    return _decode_points(body)


def decode_packets(raw: DataFrame, *, keep_body: bool = False) -> tuple[DataFrame, DataFrame]:
    """Datagrams (``payload`` binary) to packet rows and rejects with a reason.

    Headers are read as one buffer view per Arrow batch and judged by native expressions; the
    points of rejects are never decoded. With ``keep_body`` the points stay as raw bytes in ``body``
    (the form the stream operator stores).
    """
    payload = F.col("payload")
    long_enough = (F.length(payload) >= HEADER_BYTES) & (F.substring(payload, 1, 4) == F.lit(bytearray(MAGIC)))
    prefix = F.rpad(F.substring(payload, 1, HEADER_BYTES), F.lit(HEADER_BYTES), F.lit(bytearray(1)))
    tagged = raw.withColumn("_h", _decode_headers(prefix))
    h = {name: F.col(f"_h.{name}") for name in HEADER_SCHEMA.fieldNames()}
    reason = first_reason([
        (long_enough, "short_or_magic"),
        (h["version"] == VERSION, "version"),
        (h["header_bytes"] == HEADER_BYTES, "header_bytes"),
        (h["point_stride"] == POINT_BYTES, "point_stride"),
        ((h["segment_count"] > 0) & (h["segment_index"] < h["segment_count"]), "segment"),
        (h["point_count"] <= MAXIMUM_POINTS_PER_PACKET, "point_count"),
        (F.length(payload) == HEADER_BYTES + h["point_count"] * POINT_BYTES, "size"),
        (F.least(*[h[n] for n in WIDE_FIELDS]) >= 0, "unsigned_range"),
    ])
    good, bad = split_by_reason(tagged.withColumn("reject_reason", reason))
    kept = [c for c in raw.columns if c != "payload"]
    body = F.substring(payload, HEADER_BYTES + 1, MAXIMUM_POINTS_PER_PACKET * POINT_BYTES)
    packets = good.select(
        *kept,
        *[h[n].alias(n) for n in (*WIDE_FIELDS, "segment_count", "segment_index", "point_count")],
        body.alias("body") if keep_body else _decode_points(body).alias("points"),
    )
    return packets, bad.drop("_h")


def sender_filter(packets: DataFrame, sender: str | None) -> DataFrame:
    """Keep one sender's packets; no sender keeps all."""
    return packets if sender is None else packets.where(F.col("sender") == sender)


def reassemble_batch(packets: DataFrame, *, max_points: int = 2000000) -> tuple[DataFrame, DataFrame]:
    """Complete frames with points in segment order, and one outcome row per frame group.

    The first arrival of a segment wins, reduced map-side, so a flood of copies of one segment
    never meets in one task. Frame statistics come from header columns alone; payloads are
    shuffled and gathered only for frames already known to be complete and within the bound.
    """
    heads = packets.groupBy(*FRAME_KEYS, "segment_index").agg(
        F.count(F.lit(1)).alias("copies"), F.min_by("point_count", "arrival_ns").alias("point_count"),
        F.min("arrival_ns").alias("first_ns"))
    stats = heads.groupBy(*FRAME_KEYS).agg(
        F.count(F.lit(1)).alias("segments"), F.sum("point_count").cast("long").alias("point_count"),
        (F.sum("copies") - F.count(F.lit(1))).cast("long").alias("duplicates"),
        F.max("first_ns").alias("completed_ns"))
    outcome = (
        F.when(F.col("point_count") > max_points, F.lit("oversized"))
        .when(F.col("segments") == F.col("segment_count"), F.lit("completed")).otherwise(F.lit("incomplete")))
    outcomes = stats.withColumn("outcome", outcome)
    done = outcomes.where(F.col("outcome") == "completed").select(*FRAME_KEYS, "point_count", "completed_ns")
    payload = packets.join(done.select(*FRAME_KEYS), FRAME_KEYS, "left_semi")
    parts = payload.groupBy(*FRAME_KEYS, "segment_index").agg(F.min_by("points", "arrival_ns").alias("points"))
    gathered = parts.groupBy(*FRAME_KEYS).agg(F.sort_array(F.collect_list(F.struct("segment_index", "points"))).alias("_p"))
    frames = gathered.withColumn("points", F.flatten(F.transform("_p", lambda p: p["points"]))).drop("_p")
    return frames.join(done, FRAME_KEYS), outcomes


def _stale_walk(ids: np.ndarray, times: np.ndarray, reset: int) -> np.ndarray:
    """For each row: the next row accepted after accepting it (row count = none)."""
    rows = len(ids)
    by_time = np.searchsorted(times, times + reset, side="left")
    by_time = np.maximum(by_time, np.arange(rows) + 1)
    higher = np.full(rows, rows)
    waiting: list[int] = []
    for row in range(rows):
        while waiting and ids[waiting[-1]] < ids[row]:
            higher[waiting.pop()] = row
        waiting.append(row)
    return np.minimum(by_time, higher)


def drop_stale_frames(frames: DataFrame, *, reset_s: float = 2.0, span_s: float = 3600.0,
                      keep_stale: bool = False) -> DataFrame:
    """Drop frames whose id does not exceed the last *accepted* one within the reset time.

    The rule is a fold over a sender's whole history, yet no task reads more than one sender's
    ``span_s`` of it. Whatever state a time slice starts with, it accepts a frame no later than its
    first one past ``reset_s``, and from an accepted frame the rest of the slice is fixed. So each
    slice is summarised by "if entered at this early frame, left in that state"; the tiny
    summaries are chained per sender, and each slice is then replayed from its true entry state.
    """
    reset, span = int(reset_s * 1e9), int(span_s * 1e9)
    if span < reset:
        raise ValueError("span_s must be at least reset_s")
    # Equal rows are told apart by a number, so that each gets its own verdict.
    same = Window.partitionBy("sender", "arrival_ns", "raster_frame_id").orderBy(F.lit(0))
    frames = frames.withColumn("_copy", F.row_number().over(same))
    sliced = frames.withColumn("_slice", F.floor(F.col("arrival_ns") / F.lit(span)).cast("long"))

    def summarise(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["arrival_ns", "raster_frame_id"])
        ids, times = rows["raster_frame_id"].to_numpy(), rows["arrival_ns"].to_numpy()
        following, leave = _stale_walk(ids, times, reset), np.arange(len(ids))
        for row in range(len(ids) - 2, -1, -1):
            if following[row] < len(ids):
                leave[row] = leave[following[row]]
        early = min(int(np.searchsorted(times, key[1] * span + reset, side="left")) + 1, len(ids))
        return pd.DataFrame({
            "sender": key[0], "_slice": key[1], "at": np.arange(early), "id": ids[:early], "ns": times[:early],
            "leave_id": ids[leave[:early]], "leave_ns": times[leave[:early]],
        })

    def chain(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        entries, state = [], None
        for slice_id, part in rows.sort_values(["_slice", "at"]).groupby("_slice", sort=True):
            entries.append((key[0], slice_id, *(state or (None, None))))
            ids, times = part["id"].to_numpy(), part["ns"].to_numpy()
            taken = np.arange(len(part)) if state is None else np.flatnonzero(
                (ids > state[0]) | (times - state[1] >= reset))
            if len(taken):
                state = int(part["leave_id"].iloc[taken[0]]), int(part["leave_ns"].iloc[taken[0]])
        return pd.DataFrame(entries, columns=["sender", "_slice", "entry_id", "entry_ns"]).astype(
            {"entry_id": "Int64", "entry_ns": "Int64"})

    heads = sliced.select("sender", "_slice", "arrival_ns", "raster_frame_id", "_copy")
    summary = heads.groupBy("sender", "_slice").applyInPandas(
        summarise, "sender string, _slice long, at long, id long, ns long, leave_id long, leave_ns long")
    entries = summary.groupBy("sender").applyInPandas(
        chain, "sender string, _slice long, entry_id long, entry_ns long")

    def replay(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["arrival_ns", "raster_frame_id", "_copy"])
        ids, times = rows["raster_frame_id"].to_numpy(), rows["arrival_ns"].to_numpy()
        entry_id, entry_ns = rows["entry_id"].iloc[0], rows["entry_ns"].iloc[0]
        fresh = np.zeros(len(rows), dtype=bool)
        following = _stale_walk(ids, times, reset)
        open_rows = np.arange(len(ids)) if pd.isna(entry_id) else np.flatnonzero(
            (ids > int(entry_id)) | (times - int(entry_ns) >= reset))
        row = int(open_rows[0]) if len(open_rows) else len(ids)
        while row < len(ids):
            fresh[row] = True
            row = int(following[row])
        return pd.DataFrame({"sender": key[0], "arrival_ns": times, "raster_frame_id": ids, "_copy": rows["_copy"].to_numpy(), "stale": ~fresh})

    verdict = heads.join(entries, ["sender", "_slice"]).groupBy("sender", "_slice").applyInPandas(
        replay, "sender string, arrival_ns long, raster_frame_id long, _copy int, stale boolean")
    marked = frames.join(verdict, ["sender", "arrival_ns", "raster_frame_id", "_copy"]).drop("_copy")
    return marked if keep_stale else marked.where(~F.col("stale")).drop("stale")


def link_statistics(outcomes: DataFrame, *, every: str = "5 seconds") -> DataFrame:
    """Counts per outcome and reporting interval. Rows: ts timestamp, outcome string, n long."""
    return (
        outcomes.groupBy(F.window("ts", every).alias("_w"), "outcome").agg(F.sum("n").cast("long").alias("n"))
        .select(F.col("_w.start").alias("interval_start"), "outcome", "n"))


def latest_frame_sink(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The newest waiting frame per session, and how many older ones it displaced."""
    packed = F.struct(*[c for c in batch.columns if c != "session_id"])
    picked = batch.groupBy("session_id").agg(
        F.max_by(packed, "raster_frame_id").alias("_f"), (F.count(F.lit(1)) - 1).alias("dropped_frames"))
    return picked.select("session_id", "_f.*"), picked.select("session_id", "dropped_frames")
