"""Queries of section H: packets in batch and as streams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from beamfold.operators import packets as H, raster
from beamfold.plans.catalog import query, r6, sql6, with_ctes
from beamfold.plans.geometry_queries import FRAME_CELLS, FULL_LINES
from beamfold.plans.tables import CELLS, HEIGHT, WIDTH, cells, epoch_us, table
from beamfold.schemas import PACKET_POINT
from beamfold.session import new_folder
from beamfold.sources.replay import tick_stream
from beamfold.streaming import reassembly, sinks, stale

PER_PACKET = 16


@F.arrow_udf(T.BinaryType())
def pack_datagram(frame: pa.Array, stamp: pa.Array, revision: pa.Array, count: pa.Array, index: pa.Array,
                  points: pa.Array) -> pa.Array:
    """Test bytes: what a sender would put on the wire for each packet row."""
    values, size = points.flatten(), np.diff(points.offsets.to_numpy())
    body = np.stack([values.field(values.type.get_field_index(n)).to_numpy(zero_copy_only=False) for n in PACKET_POINT.fieldNames()], axis=1).astype("<f4")
    head = np.zeros(len(points), H.HEADER_DTYPE)
    for name, column in zip(("raster_frame_id", "timestamp_ns", "config_revision", "segment_count", "segment_index"), (frame, stamp, revision, count, index)):
        head[name] = column.to_numpy(zero_copy_only=False)
    head["magic"], head["version"], head["header_bytes"], head["point_stride"] = H.MAGIC, H.VERSION, H.HEADER_BYTES, H.POINT_BYTES
    head["point_count"] = size
    ends = np.concatenate([[0], np.cumsum(H.HEADER_BYTES + size * H.POINT_BYTES)])
    data, rest = np.empty(ends[-1], np.uint8), np.ones(ends[-1], bool)
    at = ends[:-1, None] + np.arange(H.HEADER_BYTES)
    data[at], rest[at] = head.view(np.uint8).reshape(len(points), H.HEADER_BYTES), False
    data[rest] = body.view(np.uint8).ravel()
    return pa.BinaryArray.from_buffers(pa.binary(), len(points), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def frame_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, _ = raster.raster_frames_by_id(cells(spark, sf_dir), WIDTH, HEIGHT)
    return H.packetize(frames, points_per_packet=PER_PACKET)[0]


PACKETS = f"""shown_points AS (
  SELECT session_id, scan_frame_index + 1 AS raster_frame_id, px, pv, shown,
         row_number() OVER (PARTITION BY session_id, scan_frame_index, shown ORDER BY y_index, x_index) - 1 AS n,
         count(*) FILTER (shown) OVER (PARTITION BY session_id, scan_frame_index) AS total,
         max(host_timestamp_ns) OVER (PARTITION BY session_id, scan_frame_index) AS timestamp_ns,
         max(config_revision) OVER (PARTITION BY session_id, scan_frame_index) AS config_revision FROM frame_cells),
packets AS (
  SELECT session_id, raster_frame_id, CAST(CASE WHEN shown THEN n // {PER_PACKET} ELSE 0 END AS INTEGER) AS segment_index,
         CAST(greatest((total + {PER_PACKET - 1}) // {PER_PACKET}, 1) AS INTEGER) AS segment_count, timestamp_ns, config_revision,
         CAST(count(*) FILTER (shown) AS INTEGER) AS point_count, coalesce(sum(px), 0) AS x_sum, coalesce(sum(CAST(px AS FLOAT)::DOUBLE), 0) AS xf_sum,
         coalesce(sum(CAST(pv AS FLOAT)::DOUBLE), 0) AS vf_sum
  FROM shown_points GROUP BY ALL)"""
PACKET_CTES = (CELLS, FULL_LINES, FRAME_CELLS, PACKETS)


def total(column: str, field: str) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda a, p: a + p[field].cast("double"))


@query("H1_packetize", with_ctes(*PACKET_CTES, select=f"""
SELECT session_id, raster_frame_id, segment_index, segment_count, point_count, {sql6("x_sum", "x_sum")} FROM packets"""))
def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_packets(spark, sf_dir).select(
        "session_id", "raster_frame_id", "segment_index", "segment_count", "point_count", r6(total("points", "x")).alias("x_sum"))


@query("H1_rejects", """
SELECT s_suppkey AS raster_frame_id, CASE WHEN s_suppkey % 11 <> 5 THEN CAST(s_suppkey % 7 * 20000 AS INTEGER) END AS points_in_frame,
       CASE WHEN s_suppkey % 11 = 5 THEN 'points' ELSE 'segment_count' END AS reject_reason
FROM supplier WHERE s_suppkey % 11 = 5 OR s_suppkey % 7 > 3""")
def h1_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Up to 120,000 points of one supplier's balance a frame, none, or no list at all.
    k = F.col("s_suppkey")
    points = F.when(k % 11 != 5, F.array_repeat(F.struct(F.col("s_acctbal").cast("double").alias("x")), (k % 7 * 20000).cast("int")))
    frames = table(spark, sf_dir, "supplier").select(k.alias("raster_frame_id"), points.alias("points"))
    return H.packetize(frames, points_per_packet=1)[1].select("raster_frame_id", "points_in_frame", "reject_reason")


def datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire bytes of the frames' packets, some of them damaged by position."""
    packets = frame_packets(spark, sf_dir)
    names = ("raster_frame_id", "timestamp_ns", "config_revision", "segment_count", "segment_index", "points")
    payload = pack_datagram(*[F.col(n) for n in names])
    key = F.col("raster_frame_id") * 7 + F.col("segment_index")
    raw = packets.select(
        F.col("session_id").alias("sender"), F.col("raster_frame_id").alias("sent_frame"),
        F.col("segment_index").alias("sent_segment"), key.alias("key"), payload.alias("payload"))
    size = F.length("payload")
    broken = (
        F.when(F.col("key") % 13 == 0, F.concat(F.lit(bytearray(b"X")), F.substring("payload", 2, 1 << 16)))
        .when(F.col("key") % 17 == 0, F.concat(F.substring("payload", 1, 4), F.lit(bytearray(b"\1\0")), F.substring("payload", 7, 1 << 16)))
        .when(F.col("key") % 19 == 0, F.expr("substring(payload, 1, length(payload) - 3)"))
        .when(F.col("key") % 23 == 0, F.substring("payload", 1, 39))
        .otherwise(F.col("payload")))
    return raw.withColumn("payload", broken)


@query("H3_decode_packets", with_ctes(*PACKET_CTES, select=f"""
SELECT session_id AS sender, raster_frame_id, timestamp_ns, config_revision, segment_count, segment_index, point_count,
       {sql6("xf_sum", "x_sum")}, {sql6("vf_sum", "v_sum")} FROM packets, LATERAL (SELECT raster_frame_id * 7 + segment_index AS key)
WHERE key % 13 <> 0 AND key % 17 <> 0 AND key % 19 <> 0 AND key % 23 <> 0"""))
def h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = H.decode_packets(datagrams(spark, sf_dir))
    return good.select(
        "sender", "raster_frame_id", "timestamp_ns", "config_revision", "segment_count", "segment_index", "point_count",
        r6(total("points", "x")).alias("x_sum"), r6(total("points", "velocity")).alias("v_sum"))


@query("H3_rejected_packets", with_ctes(*PACKET_CTES, select="""
SELECT session_id AS sender, raster_frame_id AS sent_frame, segment_index AS sent_segment,
       CASE WHEN key % 13 = 0 THEN 'short_or_magic' WHEN key % 17 = 0 THEN 'version' WHEN key % 19 = 0 THEN 'size'
            ELSE 'short_or_magic' END AS reject_reason
FROM packets, LATERAL (SELECT raster_frame_id * 7 + segment_index AS key)
WHERE key % 13 = 0 OR key % 17 = 0 OR key % 19 = 0 OR key % 23 = 0"""))
def h3_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.decode_packets(datagrams(spark, sf_dir))[1].select("sender", "sent_frame", "sent_segment", "reject_reason")


def line_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as packets: one frame per order, segments by line number, some copied, some missing."""
    key = F.col("l_orderkey")
    count = (key % 4 + 1).cast("int")
    segment = ((F.col("l_linenumber") - 1) % count).cast("int")
    size = F.col("l_quantity").cast("int")
    number = [F.lit(0.0).cast("float").alias(n) for n in ("y", "z", "intensity", "velocity")]
    point = F.struct(F.col("l_discount").cast("float").alias("x"), *number)
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("n"), (key % 3).cast("string")).alias("sender"), key.alias("raster_frame_id"),
        (key * 10).alias("timestamp_ns"), (key % 2).alias("config_revision"), count.alias("segment_count"),
        segment.alias("segment_index"), size.alias("point_count"), F.array_repeat(point, size).alias("points"),
        (F.col("l_partkey") * 100000000 + F.round(F.col("l_extendedprice") * 100).cast("long")).alias("arrival_ns"))


LINE_PACKETS = """received AS (
  SELECT 'n' || (l_orderkey % 3) AS sender, l_orderkey AS raster_frame_id, CAST(l_orderkey % 4 + 1 AS INTEGER) AS segment_count,
         (l_linenumber - 1) % (l_orderkey % 4 + 1) AS segment_index, CAST(l_quantity AS INTEGER) AS point_count, l_discount,
         row_number() OVER (PARTITION BY l_orderkey, (l_linenumber - 1) % (l_orderkey % 4 + 1)
                            ORDER BY l_partkey * 100000000 + CAST(round(l_extendedprice * 100) AS BIGINT)) AS copy FROM lineitem),
grouped AS (
  SELECT sender, raster_frame_id, segment_count, count(*) FILTER (copy = 1) AS segments,
         CAST(sum(point_count) FILTER (copy = 1) AS BIGINT) AS point_count, count(*) FILTER (copy > 1) AS duplicates,
         sum(point_count * CAST(CAST(l_discount AS FLOAT) AS DOUBLE)) FILTER (copy = 1) AS x_sum FROM received GROUP BY ALL),
judged AS (SELECT *, CASE WHEN point_count > 120 THEN 'oversized' WHEN segments = segment_count THEN 'completed' ELSE 'incomplete' END
           AS outcome FROM grouped)"""


@query("H4_sender_filter", with_ctes(LINE_PACKETS, select="""
SELECT sender, raster_frame_id, CAST(segment_index AS INTEGER) AS segment_index, point_count FROM received WHERE sender = 'n1'"""))
def h4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = H.sender_filter(line_packets(spark, sf_dir), "n1")
    return kept.select("sender", "raster_frame_id", "segment_index", "point_count")


@query("H5_reassemble_batch", with_ctes(LINE_PACKETS, select=f"""
SELECT sender, raster_frame_id, segment_count, point_count, {sql6("x_sum", "x_sum")} FROM judged WHERE outcome = 'completed'"""))
def h5(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, _ = H.reassemble_batch(line_packets(spark, sf_dir), max_points=120)
    # The point count comes from the gathered payload, so a lost or doubled segment would show.
    return frames.select("sender", "raster_frame_id", "segment_count", F.size("points").cast("long").alias("point_count"),
                         r6(total("points", "x")).alias("x_sum"))


@query("H5_outcomes", with_ctes(LINE_PACKETS, select="""
SELECT sender, raster_frame_id, segment_count, segments, point_count, duplicates, outcome FROM judged"""))
def h5_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, outcomes = H.reassemble_batch(line_packets(spark, sf_dir), max_points=120)
    return outcomes.select("sender", "raster_frame_id", "segment_count", "segments", "point_count", "duplicates", "outcome")


TICKS = 6


def source_stream(spark: SparkSession, sf_dir: str, name: str, order: str) -> DataFrame:
    """One driver table as a stream of ``TICKS`` micro-batches, by equal parts of the order column's range."""
    df = table(spark, sf_dir, name)
    at = epoch_us(df, order) if "timestamp" in df.schema[order].dataType.typeName() else F.col(order)
    low, high = df.agg(F.min(at), F.max(at)).first()
    path = new_folder(spark, "ticks")
    df.withColumn("tick", F.floor((at - low) * TICKS / (high - low + 1)).cast("long")).write.partitionBy("tick").parquet(path)
    return tick_stream(spark, path, df.schema)


def body_packets(lines: DataFrame) -> DataFrame:
    """``lineitem`` as raw packets, one frame every 10 ms; copies of a segment trail it by microseconds, so that they arrive before
    the next segment however many parts there are."""
    key = F.col("l_orderkey")
    count = (key % 4 + 1).cast("int")
    segment = ((F.col("l_linenumber") - 1) % count).cast("int")
    return lines.select(
        F.concat(F.lit("n"), (key % 3).cast("string")).alias("receiver"), key.alias("raster_frame_id"),
        (key * 10).alias("timestamp_ns"), (key % 2).alias("config_revision"), count.alias("segment_count"),
        segment.alias("segment_index"), (segment + 1).alias("point_count"),
        F.unhex(F.repeat(F.lit("0000803F" * 5), segment + 1)).alias("body"),
        (key * 10000000 + segment * 1000000 + F.col("l_partkey") % 20000 * 40 + F.col("l_linenumber")).alias("arrival_ns"))


@query("H6_reassemble_stream", with_ctes("""received AS (
  SELECT l_orderkey AS f, l_orderkey % 4 + 1 AS n, (l_linenumber - 1) % (l_orderkey % 4 + 1) AS s FROM lineitem),
frames AS (SELECT f, n, count(DISTINCT s) AS segments, count(*) AS packets FROM received GROUP BY f, n)""", select="""
SELECT 'n' || (f % 3) AS receiver, f AS raster_frame_id, CASE WHEN n = 1 THEN packets ELSE 1 END AS times_completed,
       (CASE WHEN n = 1 THEN packets ELSE 1 END) * (n * (n + 1) // 2) AS points
FROM frames WHERE segments = n"""))
def h6(spark: SparkSession, sf_dir: str) -> DataFrame:
    reassembly.use_rocksdb(spark)
    out = new_folder(spark, "frames")
    stream = reassembly.reassemble_stream(body_packets(source_stream(spark, sf_dir, "lineitem", "l_orderkey")))
    sinks.drain_table(stream, out)
    done = spark.read.parquet(out).where("outcome = 'completed'")
    return done.groupBy("receiver", "raster_frame_id").agg(
        F.count(F.lit(1)).alias("times_completed"), F.sum(F.floor(F.length("body") / 20)).cast("long").alias("points"))


def event_frames(df: DataFrame) -> DataFrame:
    """``events`` as completed frames of four senders whose counter restarts every 700 frames."""
    return df.select(
        F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("sender"),
        (F.col("event_id") * 37 % 700).alias("raster_frame_id"), (epoch_us(df, "ts") * 1000).alias("arrival_ns"))


STALE = """WITH RECURSIVE f AS (
  SELECT 'u' || (user_id % 4) AS sender, event_id * 37 % 700 AS id, epoch_us(ts) * 1000 AS ns,
         row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id * 37 % 700) AS n FROM events),
walk AS (
  SELECT sender, n, id, ns, false AS stale, id AS last_id, ns AS last_ns FROM f WHERE n = 1
  UNION ALL
  SELECT f.sender, f.n, f.id, f.ns, f.id <= w.last_id AND f.ns - w.last_ns < 3000000000000,
         CASE WHEN f.id <= w.last_id AND f.ns - w.last_ns < 3000000000000 THEN w.last_id ELSE f.id END,
         CASE WHEN f.id <= w.last_id AND f.ns - w.last_ns < 3000000000000 THEN w.last_ns ELSE f.ns END
  FROM walk w JOIN f ON f.sender = w.sender AND f.n = w.n + 1)
SELECT sender, id AS raster_frame_id, ns AS arrival_ns, stale FROM walk"""
RESET_S = 3000.0


@query("H7_drop_stale_frames", STALE)
def h7(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = event_frames(table(spark, sf_dir, "events"))
    return H.drop_stale_frames(frames, reset_s=RESET_S, span_s=86400.0, keep_stale=True)


@query("H7_drop_stale_stream", STALE)
def h7_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    reassembly.use_rocksdb(spark)
    out = new_folder(spark, "verdicts")
    frames = event_frames(source_stream(spark, sf_dir, "events", "ts"))
    sinks.drain_table(stale.drop_stale_stream(frames, reset_s=RESET_S, keep_stale=True), out)
    return spark.read.parquet(out)


def outcome_rows(df: DataFrame) -> DataFrame:
    return df.select(F.timestamp_micros(epoch_us(df, "ts")).alias("ts"), F.col("event_type").alias("outcome"),
                     (F.col("user_id") % 3 + 1).alias("n"))


STATISTICS = """SELECT epoch_us(ts) // 1000000 // 3600 * 3600 AS interval_start_s, event_type AS outcome,
  CAST(sum(user_id % 3 + 1) AS BIGINT) AS n FROM events GROUP BY ALL"""


@query("H8_link_statistics", STATISTICS)
def h8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = H.link_statistics(outcome_rows(table(spark, sf_dir, "events")), every="1 hour")
    return out.select(F.unix_seconds("interval_start").alias("interval_start_s"), "outcome", "n")


@query("H8_statistics_stream", f"""WITH s AS ({STATISTICS})
SELECT * FROM s WHERE interval_start_s + 3600 <= (SELECT epoch_us(max(ts)) / 1e6 - 10 FROM events)""")
def h8_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "statistics")
    stream = sinks.statistics_stream(outcome_rows(source_stream(spark, sf_dir, "events", "ts")), every="1 hour")
    sinks.drain_table(stream, out)
    return spark.read.parquet(out).select(F.unix_seconds("interval_start").alias("interval_start_s"), "outcome", "n")


LATEST = """SELECT 'c' || (o_custkey % 50) AS session_id, max(o_orderkey) AS raster_frame_id, count(*) - 1 AS dropped_frames FROM orders GROUP BY 1"""


def waiting_frames(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("session_id"),
                     F.col("o_orderkey").alias("raster_frame_id"), "o_totalprice")


@query("H9_latest_frame_sink", LATEST)
def h9(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, dropped = H.latest_frame_sink(waiting_frames(table(spark, sf_dir, "orders")))
    return kept.join(dropped, "session_id").select("session_id", "raster_frame_id", "dropped_frames")


@query("H9_latest_frame_stream", f"""SELECT session_id, max(o_orderkey) AS raster_frame_id, count(*) - 1 AS dropped_frames FROM
  (SELECT 'c' || (o_custkey % 50) AS session_id, o_orderkey,
          (o_orderkey - min(o_orderkey) OVER ()) * {TICKS} // (max(o_orderkey) OVER () - min(o_orderkey) OVER () + 1) AS tick FROM orders)
GROUP BY session_id, tick""")
def h9_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "latest")
    sinks.latest_frames(waiting_frames(source_stream(spark, sf_dir, "orders", "o_orderkey")), out, drain=True)
    return spark.read.parquet(out).select("session_id", "raster_frame_id", "dropped_frames")


@query("F5_latest_snapshot_stream", "SELECT 'c' || (o_custkey % 50) AS session_id, max(o_orderkey) AS raster_frame_id FROM orders GROUP BY 1")
def f5_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_folder(spark, "snapshots")
    frames = waiting_frames(source_stream(spark, sf_dir, "orders", "o_orderkey"))
    sinks.latest_snapshots(frames, out, by="raster_frame_id", drain=True)
    return sinks.read_latest(spark, out).select("session_id", "raster_frame_id")
