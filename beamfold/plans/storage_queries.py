"""Queries of section A: ingest, manifests, stores, exports, waveforms, replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beamfold.functions.kernels import unpack_samples
from beamfold.operators import raster
from beamfold.operators.records import stored_count
from beamfold.plans import fixtures
from beamfold.plans.catalog import query, r6, sql6, with_ctes
from beamfold.plans.geometry_queries import (CLOUD_ROWS, DISPLAY, FRAME_CELLS, FULL_LINES, FUSION_CTES, cloud_rows,
                                             display_cells, filled, located, sqlf)
from beamfold.plans.tables import ASCANS, CELLS, HEIGHT, WIDTH, ascans, table
from beamfold.session import new_folder
from beamfold.sources import clouds_io, recordings as A, replay, sessions, waveforms
from beamfold.streaming.sinks import drain_table


def weighted(samples: str = "samples") -> Column:
    """Order-sensitive checksum of a record's samples."""
    terms = F.transform(samples, lambda s, i: s.cast("long") * (i + 1))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda a, v: a + v)


def session_of(stem: str) -> Column:
    return F.element_at(F.split(stem, "/"), -1).alias("session_id")


SUM = "CAST(list_sum(list_transform(samples, lambda s, i: s * i)) AS BIGINT)"


@query("A1_read_recordings", with_ctes(ASCANS, select=f"""
SELECT session_id, frame_id, CASE WHEN CAST(substr(session_id, 2) AS INTEGER) % 3 = 2 THEN frame_id - 1 ELSE dma_buffer_sequence END
         AS dma_buffer_sequence,
       CAST(CASE WHEN CAST(substr(session_id, 2) AS INTEGER) % 3 = 2 THEN 0 ELSE record_index_in_buffer END AS INTEGER) AS record_index_in_buffer,
       host_timestamp_ns, config_revision, CAST(record_index_in_buffer AS INTEGER) AS x_index, 'signed_int16' AS sample_format,
       {SUM} AS checksum FROM ascans"""))
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fixtures.write_recordings(spark, sf_dir)
    rows, *_ = A.read_recordings(spark, folder, sessions=sessions.read_sessions(spark, folder), task_bytes=20000)
    return rows.where("trigger.valid").select(
        "session_id", "frame_id", "dma_buffer_sequence", "record_index_in_buffer", "host_timestamp_ns", "config_revision",
        "pos.x_index", "sample_format", weighted().alias("checksum"))


@query("A1_read_packed_recordings", with_ctes(ASCANS, select=f"""
SELECT session_id, frame_id, CAST(64 AS INTEGER) AS stored, {SUM} AS checksum FROM ascans"""))
def a1_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fixtures.write_recordings(spark, sf_dir)
    rows, *_ = A.read_recordings(spark, folder, sessions=sessions.read_sessions(spark, folder), packed=True)
    rows = rows.where("trigger.valid").withColumn("samples", unpack_samples(F.col("payload")))
    return rows.select("session_id", "frame_id", stored_count(rows.columns).alias("stored"), weighted().alias("checksum"))


@query("A1_read_batches", with_ctes(ASCANS, select="""
SELECT session_id, CASE WHEN CAST(substr(session_id, 2) AS INTEGER) % 3 = 2 THEN frame_id - 1 ELSE dma_buffer_sequence END AS sequence,
  count(*) AS record_count, min(host_timestamp_ns) AS completion_ns FROM ascans GROUP BY ALL"""))
def a1_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fixtures.write_recordings(spark, sf_dir)
    rows, batches, _ = A.read_recordings(spark, folder, sessions=sessions.read_sessions(spark, folder))
    # The records that fill up a short buffer do not count.
    spare = rows.where("not trigger.valid").groupBy("session_id", F.col("dma_buffer_sequence").alias("sequence")).agg(F.count(F.lit(1)).alias("spare"))
    return batches.join(spare, ["session_id", "sequence"], "left").select(
        "session_id", "sequence", (F.col("record_count") - F.coalesce("spare", F.lit(0))).alias("record_count"), "completion_ns")


@query("A1_rejects", with_ctes(ASCANS, """blocks AS (
  SELECT DISTINCT session_id, CAST(substr(session_id, 2) AS INTEGER) AS n, dma_buffer_sequence AS seq, CAST(dma_buffer_sequence // 5 AS INTEGER) AS part,
         max(dma_buffer_sequence) OVER (PARTITION BY session_id) AS newest FROM ascans),
parts AS (SELECT DISTINCT session_id, n, part, CASE WHEN part = 3 THEN 'stream_magic' WHEN part = 4 THEN 'not_contiguous'
  WHEN n % 3 > 0 AND n % 4 = 1 THEN 'coordinate_frame' WHEN n % 3 > 0 AND n % 4 = 2 THEN 'no_coordinate_frame' END AS reason FROM blocks)""", select="""
SELECT session_id, part, NULL::BIGINT AS block, reason FROM parts WHERE reason IS NOT NULL
UNION ALL
SELECT session_id, part, seq % 5, CASE WHEN seq % 7 = 3 THEN 'record_count' WHEN seq % 7 = 5 THEN 'payload_bytes' WHEN seq = least(4, newest) THEN 'truncated_payload'
  WHEN seq % 7 = 2 THEN 'record_unsigned_range' WHEN seq % 7 = 1 THEN 'trajectory' WHEN seq % 7 = 4 THEN 'record_index_range' ELSE 'segment_range' END
FROM blocks JOIN parts USING (session_id, n, part)
WHERE reason IS NULL AND n % 3 < 2 AND (seq % 7 IN (2, 3, 5, 6) OR n % 3 = 0 AND seq % 7 IN (1, 4) OR seq = least(4, newest))
UNION ALL
SELECT session_id, 0, max(a.frame_id) - 1, 'truncated_payload' FROM ascans a JOIN parts USING (session_id)
WHERE part = 0 AND reason IS NULL AND n % 3 = 2 AND a.dma_buffer_sequence < 5 GROUP BY session_id"""))
def a1_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fixtures.write_recordings(spark, sf_dir, damage=True, values=True, alien=True)
    rejects = A.read_recordings(spark, folder, sessions=sessions.read_sessions(spark, folder), task_bytes=20000)[2]
    return rejects.select(session_of("stem"), "part", "block", F.col("reject_reason").alias("reason"))


@query("A2_discover_parts", with_ctes(ASCANS, """parts AS (
  SELECT DISTINCT session_id, CAST(dma_buffer_sequence // 5 AS INTEGER) AS part, CAST(substr(session_id, 2) AS INTEGER) % 2 = 1 AS odd FROM ascans)""",
    select="SELECT session_id, part, NOT (odd AND part > 2) AS contiguous FROM parts WHERE NOT (odd AND part = 2)"))
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fixtures.write_recordings(spark, sf_dir, gap=True)
    found = A.discover_parts(A.read_stream_headers(A.list_parts(spark, folder)))
    return found.select(F.element_at(F.split("stem", "/"), -1).alias("session_id"), "part", "contiguous")


@query("A3_quarantine_blocks", with_ctes(ASCANS, """blocks AS (
  SELECT DISTINCT session_id, dma_buffer_sequence AS seq, max(dma_buffer_sequence) OVER (PARTITION BY session_id) AS newest FROM ascans)""",
    select="""SELECT session_id, CAST(seq // 5 AS INTEGER) AS part, seq % 5 AS block, CASE WHEN seq % 7 = 3 THEN 'record_count' WHEN seq % 7 = 5 THEN 'payload_bytes'
  WHEN seq = least(4, newest) THEN 'truncated_payload' ELSE 'ok' END AS verdict FROM blocks"""))
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fixtures.write_recordings(spark, sf_dir, damage=True)
    good, bad = A.quarantine_blocks(A.scan_blocks(A.read_stream_headers(A.list_parts(spark, folder))))
    session = F.element_at(F.split("stem", "/"), -1).alias("session_id")
    return good.select(session, "part", "block", F.lit("ok").alias("verdict")).unionByName(
        bad.select(session, "part", "block", F.col("reject_reason").alias("verdict")))


@query("A3_bad_values", with_ctes(ASCANS, """blocks AS (SELECT DISTINCT session_id, dma_buffer_sequence AS seq FROM ascans)""", select="""
SELECT session_id, CAST(seq // 5 AS INTEGER) AS part, seq % 5 AS block, CASE seq % 7 WHEN 1 THEN 'trajectory' WHEN 2 THEN 'record_unsigned_range'
  WHEN 4 THEN 'record_index_range' WHEN 6 THEN 'segment_range' ELSE 'ok' END AS verdict FROM blocks"""))
def a3_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fixtures.write_recordings(spark, sf_dir, values=True)
    good, bad = A.quarantine_blocks(A.scan_blocks(A.read_stream_headers(A.list_parts(spark, folder))))
    # Good blocks are those that decode; each shows by its first record.
    read = A.decode_blocks(good).where("record_index_in_buffer = 0").select(
        "session_id", F.expr("cast(dma_buffer_sequence div 5 as int)").alias("part"), (F.col("dma_buffer_sequence") % 5).alias("block"), F.lit("ok").alias("verdict"))
    return read.unionByName(bad.select(session_of("stem"), "part", "block", F.col("reject_reason").alias("verdict")))


@query("A5_read_sessions", f"""
SELECT s_name AS session_id, s_suppkey AS blocks_written, s_suppkey % 2 = 0 AS completed, CAST(3 AS INTEGER) AS format_version,
       {sql6("s_acctbal * 1e3", "sample_rate_hz")}, CAST(2 AS INTEGER) AS files, CAST(s_nationkey AS VARCHAR) AS lines FROM supplier""")
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "sidecars")
    k = F.col("s_suppkey")
    stream = F.struct(F.lit(3).alias("format_version"), F.lit("a").alias("channel"), (F.col("s_acctbal") * 1e3).alias("sample_rate_hz"),
                      F.lit(4096).alias("record_length"), F.lit(64).alias("records_per_buffer"))
    document = F.struct(
        F.col("s_name").alias("session_id"), (k % 2 == 0).alias("completed"), k.alias("blocks_written"),
        F.array(F.lit("a.raw.0000.bin"), F.lit("a.raw.0001.bin")).alias("data_files"), stream.alias("raw_stream"),
        F.create_map(F.lit("scan.y_line_count"), F.col("s_nationkey").cast("string")).alias("config_snapshot"))
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(k.cast("string"), F.lit(".raw.json")).alias("name"), F.to_json(document, {"pretty": "true"}).alias("text"))
    fixtures.write_documents(rows, folder, "name", "text")
    return sessions.read_sessions(spark, folder).select(
        "session_id", "blocks_written", "completed", "raw_stream.format_version",
        r6("raw_stream.sample_rate_hz").alias("sample_rate_hz"), F.size("data_files").alias("files"),
        F.col("config_snapshot")["scan.y_line_count"].alias("lines"))


@query("A6_write_ascans", with_ctes(ASCANS, select=f"""
SELECT session_id, dma_buffer_sequence, count(*) AS records, CAST(sum({SUM}) AS BIGINT) AS checksum, CAST(1 AS BIGINT) AS files
FROM ascans GROUP BY ALL"""))
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "ascans")
    A.write_ascans(ascans(spark, sf_dir), path, split_gb=2e-5)
    stored = A.read_ascans(spark, path, unpack=True).withColumn("_file", F.col("_metadata.file_path"))
    return stored.groupBy("session_id", "dma_buffer_sequence").agg(
        F.count(F.lit(1)).alias("records"), F.sum(weighted()).alias("checksum"), F.count_distinct("_file").alias("files"))


@query("A8_write_read_clouds", with_ctes(CELLS, FULL_LINES, FRAME_CELLS, select=CLOUD_ROWS + " WHERE scan_frame_index % 4 <> 1"))
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "clouds")
    clouds = raster.assemble_cloud(located(spark, sf_dir), WIDTH, HEIGHT)
    # Every fourth frame is marked incomplete or loses a point; neither may reach the store.
    spoiled = F.col("scan_frame_index") % 4 == 1
    clouds = clouds.withColumn("complete", ~(spoiled & (F.col("scan_frame_index") % 8 == 1))).withColumn(
        "points", F.when(spoiled & (F.col("scan_frame_index") % 8 == 5), F.slice("points", 1, 49)).otherwise(F.col("points")))
    clouds_io.write_clouds(clouds, path)
    return cloud_rows(clouds_io.read_clouds(spark, path))


@query("A9_write_manifest", with_ctes(ASCANS, """stored AS (
  SELECT session_id, count(DISTINCT dma_buffer_sequence) AS blocks_written, count(*) AS records_written, count(*) * 128 AS bytes_written,
         min(host_timestamp_ns) AS start_timestamp_ns, max(host_timestamp_ns) AS end_timestamp_ns, count(DISTINCT dma_buffer_sequence // 8) AS files,
         (SELECT count(DISTINCT o_orderkey % 5000 // 50) FROM orders WHERE 's' || (o_orderkey // 5000) = session_id) AS frames_written
  FROM ascans GROUP BY session_id),
closings AS (SELECT 's' || k AS session_id, k % 2 = 0 AS completed, CASE WHEN k % 2 = 0 THEN 'operator' ELSE 'disk full' END AS stop_reason
  FROM (SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS k FROM nation) WHERE k % 5 <> 1)""", select="""
SELECT session_id, coalesce(blocks_written, 0) AS blocks_written, coalesce(records_written, 0) AS records_written, coalesce(bytes_written, 0) AS bytes_written,
       coalesce(start_timestamp_ns, -1) AS start_timestamp_ns, coalesce(end_timestamp_ns, -1) AS end_timestamp_ns, coalesce(frames_written, 0) AS frames_written,
       CAST(coalesce(files, 0) AS INTEGER) AS files, coalesce(completed, false) AS completed, coalesce(stop_reason, '-') AS stop_reason,
       CAST(CASE WHEN blocks_written > 0 THEN 10 ELSE -1 END AS INTEGER) AS records_per_buffer
FROM stored FULL JOIN closings USING (session_id)"""))
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), F.floor(F.col("o_orderkey") / 5000).cast("string")).alias("session_id"),
        F.floor(F.col("o_orderkey") % 5000 / 50).alias("frame")).distinct()
    # Recorders of some sessions never said how they ended; others have nothing stored.
    k = F.col("n_nationkey").cast("long")
    closings = table(spark, sf_dir, "nation").where(k % 5 != 1).select(
        F.concat(F.lit("s"), k.cast("string")).alias("session_id"), (k % 2 == 0).alias("completed"),
        F.when(k % 2 == 0, "operator").otherwise("disk full").alias("stop_reason"), F.lit(7).cast("long").alias("end_timestamp_utc_ns"))
    store, path = new_folder(spark, "ascans"), new_folder(spark, "manifest")
    A.write_ascans(ascans(spark, sf_dir), store, split_gb=2e-5)
    stored = A.read_ascans(spark, store).withColumn("file", F.col("_metadata.file_path"))
    sessions.write_manifest(stored, frames, path, closings=closings, file="file")

    def filled(name: str, missing: object) -> Column:
        return F.coalesce(F.col(name), F.lit(missing)).alias(name.split(".")[-1])

    return spark.read.parquet(path).select(
        "session_id", "blocks_written", "records_written", "bytes_written", filled("start_timestamp_ns", -1), filled("end_timestamp_ns", -1),
        "frames_written", F.size("data_files").alias("files"), "completed", filled("stop_reason", "-"),
        filled("raw_stream.records_in_buffer", -1).alias("records_per_buffer"))


CSV = {"x_forward_m": "x", "y_left_m": "y", "z_up_m": "z", "intensity_db": "intensity", "velocity_mps": "velocity",
       "scan_x_command": "scan_x", "scan_y_command": "scan_y"}


@query("A10_export_cloud_csv", with_ctes(*FUSION_CTES, DISPLAY, select=f"""
SELECT {', '.join(sql6(source, name) for name, source in CSV.items())}, CAST(interpolated AS INTEGER) AS display_interpolated,
       CAST(seen AS INTEGER) AS temporal_observations FROM display WHERE x IS NOT NULL"""))
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "csv")
    clouds_io.export_cloud_csv(display_cells(spark, sf_dir), path)
    schema = ", ".join(f"{n} double" for n in CSV) + ", display_interpolated int, temporal_observations int"
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").csv(path).withColumns(
        {n: r6(n) for n in CSV})


def waveform_files(spark: SparkSession, sf_dir: str) -> str:
    """``events`` as waveform texts of 500 rows, each bucket one file, some with a broken row or header."""
    e = F.col("event_id")
    bucket = F.floor(e / 500).cast("long")
    events = table(spark, sf_dir, "events")
    line = F.concat_ws(" ", F.col("value").cast("string"), (e % 17 - 8).cast("string"), F.when(F.col("event_type") == "click", "1.0").otherwise("0"))
    broken = (e % 500 == 77) & (bucket % 6 == 3)
    rows = events.select(
        bucket.alias("bucket"), (e % 500 + 1).alias("n"),
        F.when(broken, F.lit("1.0 oops 0")).when(e % 50 == 0, F.concat(F.lit("\t\n"), line)).otherwise(line).alias("value"))
    heads = rows.select("bucket").distinct().select(
        "bucket", F.lit(0).cast("long").alias("n"),
        F.when(F.col("bucket") % 6 == 5, "rate 5").otherwise(F.concat(F.lit("﻿SPS "), (F.col("bucket") * 100 + 1000).cast("string"))).alias("value"))
    path = new_folder(spark, "waveforms")
    rows.unionByName(heads).repartition("bucket").sortWithinPartitions("bucket", "n").select("bucket", "value").write.partitionBy("bucket").text(path)
    return path


def bucket_of(column: str) -> Column:
    return F.regexp_extract(column, r"bucket=(\d+)", 1).cast("long").alias("bucket")


@query("A11_read_waveform", f"""
SELECT event_id // 500 AS bucket, event_id % 500 AS idx, {sql6("value", "x")}, {sql6("event_id % 17 - 8", "y")}, event_type = 'click' AS trigger,
       {sql6("event_id // 500 * 100 + 1000", "sample_rate_hz")} FROM events WHERE event_id // 500 % 6 NOT IN (3, 5)""")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = waveforms.read_waveform(spark, waveform_files(spark, sf_dir))
    return rows.select(bucket_of("waveform_id"), "idx", r6("x").alias("x"), r6("y").alias("y"), "trigger",
                       r6("sample_rate_hz").alias("sample_rate_hz"))


@query("A11_waveform_issues", """
SELECT event_id // 500 AS bucket, CAST(CASE WHEN event_id // 500 % 6 = 5 THEN 1 ELSE 77 + 2 + 2 END AS INTEGER) AS line,
       CASE WHEN event_id // 500 % 6 = 5 THEN 'bad_header' ELSE 'bad_row' END AS message
FROM events WHERE event_id % 500 = 77 AND event_id // 500 % 6 IN (3, 5)""")
def a11_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, issues = waveforms.read_waveform(spark, waveform_files(spark, sf_dir))
    return issues.select(bucket_of("file"), "line", "message")


@query("A12_replay_stream", with_ctes(ASCANS, """kept AS (
  SELECT *, row_number() OVER w - 1 AS i, dense_rank() OVER (PARTITION BY session_id ORDER BY dma_buffer_sequence) - 1 AS b,
         count(*) OVER (PARTITION BY session_id) AS total, count(*) OVER (PARTITION BY session_id, dma_buffer_sequence) AS size,
         row_number() OVER (PARTITION BY session_id, dma_buffer_sequence ORDER BY record_index_in_buffer) - 1 AS r
  FROM ascans WINDOW w AS (PARTITION BY session_id ORDER BY dma_buffer_sequence, record_index_in_buffer)),
sizes AS (SELECT session_id, max(b) + 1 AS buffers FROM kept GROUP BY session_id)""", select=f"""
SELECT session_id, i + 1 + loop * total AS frame_id, i + 1 + loop * total AS trigger_sequence, b + loop * buffers AS dma_buffer_sequence,
       CAST(r AS INTEGER) AS record_index_in_buffer, CAST(size AS INTEGER) AS records_in_buffer, {SUM} AS checksum
FROM kept JOIN sizes USING (session_id), range(2) AS g(loop)"""))
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The stored numbers jump after every fourth buffer and frames begin at 1001, so restamping really changes them.
    number = F.col("dma_buffer_sequence")
    recorded = ascans(spark, sf_dir).drop("label").withColumns({
        "dma_buffer_sequence": number + F.floor(number / 4), "frame_id": F.col("frame_id") + 1000,
        "trigger": F.struct((F.col("frame_id") + 7).alias("sequence"), *(F.lit(None).cast(t).alias(n) for n, t in (
            ("timestamp_ns", "long"), ("period_jitter_ns", "long"), ("missed_trigger_count", "long"), ("valid", "boolean"))))})
    published, out = new_folder(spark, "replay"), new_folder(spark, "replayed")
    replay.publish_replay(recorded, published, loops=2, buffers_per_tick=8)
    drain_table(replay.replay_stream(spark, published, ticks_per_trigger=2), out)
    return spark.read.parquet(out).select(
        "session_id", "frame_id", F.col("trigger.sequence").alias("trigger_sequence"), "dma_buffer_sequence", "record_index_in_buffer", "records_in_buffer", weighted().alias("checksum"))
