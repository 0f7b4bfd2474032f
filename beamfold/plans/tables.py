"""The driver's tables seen as scan tables, in Spark and as SQL common table expressions.

- ``embeddings``: 64-sample records (UP = first 32, DOWN = last 32), 10 per buffer, 250 per session.
- ``orders``: measured raster cells, 10 x 5 per frame, 5000 per session.
- ``events``: waveforms of 500 points, telemetry stamps, frame arrivals.
- ``region``: one processing configuration per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beamfold.schemas import FULL_CHIRP_PERIOD, SIGNED_INT16

WIDTH, HEIGHT = 10, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp column, whatever the session's time zone."""
    if df.schema[name].dataType.typeName() == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {name})")
    return F.unix_micros(name)


def config(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")

    def real(value: float) -> Column:
        return F.lit(float(value))

    return table(spark, sf_dir, "region").select(
        k.cast("long").alias("config_revision"),
        F.lit("a").alias("channel"), F.lit(64).alias("sample_point"),
        F.lit(0).alias("up_start"), F.lit(32).alias("up_end"), F.lit(32).alias("down_start"), F.lit(64).alias("down_end"),
        F.lit(64).alias("fft_length"), F.lit("hann").alias("window_function"), (k % 2 == 0).alias("remove_dc"),
        F.lit(True).alias("invert_down"), F.lit(2).alias("peak_start"), F.lit(30).alias("peak_end"),
        (real(-22) - k).alias("threshold_db"), real(1e9).alias("sweep_bandwidth_hz"), real(2e5).alias("sweep_rate_hz"),
        real(1550).alias("wavelength_nm"), (real(1) + k * real(0.01)).alias("distance_scale"),
        (k * real(0.1)).alias("distance_offset_m"), real(1).alias("velocity_scale"), real(0).alias("velocity_offset_mps"),
        real(1.25).alias("x_angle_offset_deg"), real(-0.75).alias("y_angle_offset_deg"),
        F.lit(WIDTH).alias("x_pixel_count"), F.lit(HEIGHT).alias("y_line_count"), real(-9).alias("x_start_deg"),
        real(9).alias("x_end_deg"), real(-4).alias("y_start_deg"), real(4).alias("y_end_deg"),
        (k % 2 == 1).alias("bidirectional"),
        real(1e5).alias("scanner_sample_rate_hz"), real(1e7).alias("sample_rate_hz"), F.lit(WIDTH).alias("records_per_buffer"))


CFG = """cfg AS (
  SELECT CAST(r_regionkey AS BIGINT) AS config_revision, r_regionkey % 2 = 0 AS remove_dc,
         -22e0 - r_regionkey AS threshold_db, 1e0 + r_regionkey * 0.01e0 AS distance_scale,
         r_regionkey * 0.1e0 AS distance_offset_m, r_regionkey % 2 = 1 AS bidirectional
  FROM region)"""


def _segment(start: int, end: int) -> Column:
    return F.struct(F.lit(start).alias("start"), F.lit(end).alias("end_excl"))


def no_position() -> Column:
    return F.lit(None).cast(
        "struct<x_index:int,y_index:int,trajectory_sample_index:bigint,x_command:double,y_command:double,"
        "x_angle_deg:double,y_angle_deg:double,fast_axis:string,direction:string,source:string,"
        "angle_calibrated:boolean,valid:boolean>")


def ascans(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    place = v % 250
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("s"), F.floor(v / 250).cast("string")).alias("session_id"),
        (place + 1).alias("frame_id"),
        F.floor(place / WIDTH).cast("long").alias("dma_buffer_sequence"),
        (place % WIDTH).cast("int").alias("record_index_in_buffer"),
        F.lit(WIDTH).alias("records_in_buffer"),
        (place * 5000 + 1000).cast("long").alias("host_timestamp_ns"),
        (F.floor(v / 250) % 5).cast("long").alias("config_revision"),
        F.struct((place + 1).alias("sequence"), (place * 5000).alias("timestamp_ns"),
                 F.lit(0).cast("long").alias("period_jitter_ns"), F.lit(0).cast("long").alias("missed_trigger_count"),
                 F.lit(True).alias("valid")).alias("trigger"),
        no_position().alias("pos"),
        F.struct(F.lit(1).cast("long").alias("revision"), F.lit(True).alias("laser_enabled"),
                 F.lit(False).alias("edfa_used"), F.lit(False).alias("edfa_output_enabled")).alias("optical"),
        F.lit("a").alias("channel"), F.lit(SIGNED_INT16).alias("sample_format"), F.lit(FULL_CHIRP_PERIOD).alias("frame_kind"), F.lit(1e7).alias("sample_rate_hz"),
        F.lit(64).alias("record_length"), F.lit(0).cast("long").alias("pre_trigger_samples"),
        F.lit(64).cast("long").alias("post_trigger_samples"),
        _segment(0, 32).alias("up_segment"), _segment(32, 64).alias("down_segment"),
        F.transform("embedding", lambda s: F.round(s.cast("double") * 32768.0).cast("short")).alias("samples"),
        "label")


ASCANS = """ascans AS (
  SELECT 's' || (vec_id // 250) AS session_id, vec_id % 250 + 1 AS frame_id,
         (vec_id % 250) // 10 AS dma_buffer_sequence, CAST(vec_id % 10 AS INTEGER) AS record_index_in_buffer,
         (vec_id % 250) * 5000 + 1000 AS host_timestamp_ns, (vec_id // 250) % 5 AS config_revision, label,
         list_transform(embedding, lambda s: CAST(round(CAST(s AS DOUBLE) * 32768e0) AS INTEGER)) AS samples
  FROM embeddings)"""
POSITIONS = """placed AS (
  SELECT a.*, c.* EXCLUDE (config_revision), y_index, sample_no,
         CASE WHEN bidirectional AND y_index % 2 = 1 THEN 9 - sample_no % 10 ELSE sample_no % 10 END AS x_index
  FROM (SELECT *, frame_id - 1 AS sample_no, ((frame_id - 1) // 10) % 5 AS y_index FROM ascans) a
  JOIN cfg c ON a.config_revision = c.config_revision),
posed AS (
  SELECT *, -1e0 + 2e0 * x_index / 9 AS x_command, 1e0 - 2e0 * y_index / 4 AS y_command,
         -9e0 + 18e0 * (x_index / 9e0) AS x_angle_deg, 4e0 - 8e0 * (y_index / 4e0) AS y_angle_deg
  FROM placed)"""
SEGMENTS = """samples_long AS (
  SELECT session_id, frame_id, record_index_in_buffer, dma_buffer_sequence, config_revision,
         CASE WHEN i < 32 THEN 'up' ELSE 'down' END AS seg, CAST(i % 32 AS INTEGER) AS j, samples[i + 1] / 32768e0 AS v
  FROM ascans, range(64) AS g(i)),
centred AS (
  SELECT s.*, v - CASE WHEN remove_dc THEN avg(v) OVER (PARTITION BY session_id, frame_id, seg) ELSE 0e0 END AS c
  FROM samples_long s JOIN cfg USING (config_revision)),
windowed AS (
  SELECT *, CASE WHEN seg = 'down' THEN -c ELSE c END * (0.5e0 - 0.5e0 * cos(2e0 * pi() * j / 31e0)) AS w
  FROM centred)"""
SPECTRUM = """spectrum AS (
  SELECT session_id, frame_id, record_index_in_buffer, dma_buffer_sequence, config_revision, seg, CAST(k AS INTEGER) AS k,
         sum(w * cos(2e0 * pi() * k * j / 64e0)) AS re, -sum(w * sin(2e0 * pi() * k * j / 64e0)) AS im
  FROM windowed, range(33) AS g(k) GROUP BY ALL),
levels AS (
  SELECT *, re * re + im * im AS power, 20e0 * log10(greatest(2e0 * sqrt(re * re + im * im) / 15.5e0, 1e-10)) AS db
  FROM spectrum)"""
PEAKS = """neighbours AS (
  SELECT *, lag(db) OVER p AS left_db, lead(db) OVER p AS right_db,
         row_number() OVER (PARTITION BY session_id, frame_id, seg ORDER BY power DESC, k) AS strongest
  FROM levels WHERE k BETWEEN 2 AND 30 WINDOW p AS (PARTITION BY session_id, frame_id, seg ORDER BY k)),
vertex AS (
  SELECT *, CASE WHEN left_db - 2 * db + right_db < -1e-6
                  AND abs(0.5e0 * (left_db - right_db) / (left_db - 2 * db + right_db)) <= 0.5e0
            THEN 0.5e0 * (left_db - right_db) / (left_db - 2 * db + right_db) END AS shift
  FROM neighbours WHERE strongest = 1),
peaks AS (
  SELECT session_id, frame_id, record_index_in_buffer, dma_buffer_sequence, config_revision, seg, db > threshold_db AS valid,
         CAST(CASE WHEN db > threshold_db THEN k ELSE -1 END AS INTEGER) AS discrete_bin,
         CASE WHEN db > threshold_db THEN k + coalesce(shift, 0) END AS peak_bin,
         CASE WHEN db > threshold_db THEN db - coalesce(0.25e0 * (left_db - right_db) * shift, 0) END AS magnitude_db
  FROM vertex JOIN cfg USING (config_revision))"""
MEASURED = """measured AS (
  SELECT p.*, u.valid AND d.valid AS measurement_valid, u.discrete_bin AS up_bin, d.discrete_bin AS down_bin,
         u.peak_bin AS up_peak, d.peak_bin AS down_peak, u.magnitude_db AS up_db, d.magnitude_db AS down_db,
         CASE WHEN u.valid AND d.valid THEN
           (299792458e0 * ((u.peak_bin + d.peak_bin) * (1e7 / 64)) / (8e0 * 1e9 * 2e5)) * distance_scale + distance_offset_m
         END AS distance_m,
         CASE WHEN u.valid AND d.valid THEN 1550e0 * 1e-9 * ((u.peak_bin - d.peak_bin) * (1e7 / 64)) / 4e0 END AS velocity_mps,
         CASE WHEN u.valid AND d.valid THEN 0.5e0 * (u.magnitude_db + d.magnitude_db) END AS intensity_db
  FROM posed p JOIN peaks u ON p.session_id = u.session_id AND p.frame_id = u.frame_id AND u.seg = 'up'
  JOIN peaks d ON p.session_id = d.session_id AND p.frame_id = d.frame_id AND d.seg = 'down')"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured raster cells from ``orders``; every 211th has no position."""
    key = F.col("o_orderkey")
    place = key % 5000
    y = (F.floor(place / WIDTH) % HEIGHT).cast("int")
    x = F.when(y % 2 == 1, WIDTH - 1 - place % WIDTH).otherwise(place % WIDTH).cast("int")
    up_ok, down_ok, located = F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus") != "P", key % 211 != 0
    both = up_ok & down_ok
    shown = both & located

    def peak(ok: Column, refined: Column, level: Column) -> Column:
        return F.struct(
            F.when(ok, F.rint(refined)).otherwise(F.lit(-1)).cast("int").alias("discrete_bin"),
            F.when(ok, refined).alias("peak_bin"), F.when(ok, level).alias("magnitude_db"), ok.alias("valid"))

    price, customer = F.col("o_totalprice"), F.col("o_custkey").cast("double")
    velocity = (F.col("o_custkey") % 100 - 50) / F.lit(10.0)
    point = {
        "x": F.lit(3.0) + price / 699792.457, "y": (F.col("o_custkey") % 37) / F.lit(100.0), "z": (key % 11) / F.lit(100.0),
        "intensity": -customer / 50.0, "velocity": velocity, "scan_x": x / F.lit(9.0), "scan_y": y / F.lit(4.0),
    }
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("s"), F.floor(key / 5000).cast("string")).alias("session_id"),
        (place + 1).alias("frame_id"), F.floor(place / (WIDTH * HEIGHT)).cast("long").alias("scan_frame_index"),
        F.struct(x.alias("x_index"), y.alias("y_index"), located.alias("valid")).alias("pos"),
        peak(up_ok, price / 29979.2458, -customer / 50.0).alias("up_peak"),
        peak(down_ok, customer / 100.0, -(key % 40).cast("double")).alias("down_peak"),
        both.alias("measurement_valid"),
        F.when(both, price / 299792.458).alias("distance_m"), F.when(both, velocity).alias("velocity_mps"),
        F.struct(*[F.when(shown, v).alias(n) for n, v in point.items()], shown.alias("valid")).alias("point"),
        (place * 1000).alias("host_timestamp_ns"), F.floor(place / 1250).cast("long").alias("config_revision"))


CELLS = """cells AS (
  SELECT *, CASE WHEN shown THEN 3e0 + o_totalprice / 699792.457e0 END AS px,
         CASE WHEN shown THEN (o_custkey % 37) / 100e0 END AS py, CASE WHEN shown THEN (o_orderkey % 11) / 100e0 END AS pz,
         CASE WHEN shown THEN -o_custkey / 50e0 END AS pi, CASE WHEN shown THEN (o_custkey % 100 - 50) / 10e0 END AS pv,
         CASE WHEN shown THEN x_index / 9e0 END AS psx, CASE WHEN shown THEN y_index / 4e0 END AS psy
  FROM (SELECT 's' || (o_orderkey // 5000) AS session_id, o_orderkey % 5000 + 1 AS frame_id,
               (o_orderkey % 5000) // 50 AS scan_frame_index, CAST(((o_orderkey % 5000) // 10) % 5 AS INTEGER) AS y_index,
               CAST(CASE WHEN ((o_orderkey % 5000) // 10) % 2 = 1 AND (((o_orderkey % 5000) // 10) % 5) % 2 = 1
                           OR (((o_orderkey % 5000) // 10) % 5) % 2 = 1
                    THEN 9 - o_orderkey % 10 ELSE o_orderkey % 10 END AS INTEGER) AS x_index,
               o_orderpriority <> '5-LOW' AS up_ok, o_orderstatus <> 'P' AS down_ok, o_orderkey % 211 <> 0 AS located,
               o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P' AS both_ok,
               o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P' AND o_orderkey % 211 <> 0 AS shown,
               (o_orderkey % 5000) * 1000 AS host_timestamp_ns, (o_orderkey % 5000) // 1250 AS config_revision,
               o_orderkey, o_custkey, o_totalprice
        FROM orders))"""


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500-point waveforms from ``events``; the playback trigger is the logical one shifted to other types."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.floor(e / 500).cast("string").alias("waveform_id"), (e % 500).alias("idx"),
        (F.col("value") / 100.0 - 1.0).alias("x"), ((e % 17) / F.lit(8.0) - 1.0).alias("y"),
        F.col("event_type").isin("click", "view").alias("trigger"), (F.col("event_type") == "click").alias("logical_trigger"),
        (F.lit(40000.0) + F.floor(e / 500) % 7 * 15000.0).alias("sample_rate_hz"))


WAVEFORMS = """waveforms AS (
  SELECT CAST(event_id // 500 AS VARCHAR) AS waveform_id, event_id % 500 AS idx, value / 100e0 - 1e0 AS x,
         (event_id % 17) / 8e0 - 1e0 AS y, event_type IN ('click', 'view') AS trigger, event_type = 'click' AS logical_trigger,
         40000e0 + ((event_id // 500) % 7) * 15000e0 AS sample_rate_hz
  FROM events)"""
EDGES = """edges AS (
  SELECT *, trigger AND NOT coalesce(lag(trigger) OVER w, last_value(trigger) OVER f) AS edge,
         logical_trigger AND NOT coalesce(lag(logical_trigger) OVER w, last_value(logical_trigger) OVER f) AS logical_edge
  FROM waveforms
  WINDOW w AS (PARTITION BY waveform_id ORDER BY idx),
         f AS (PARTITION BY waveform_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch telemetry from ``events``: one session per user, stamps spread by ``value``."""
    e = F.col("event_id")
    done = e * 5_000_000 + 1_000_000_000
    step = F.round(F.col("value") * 1000.0).cast("long")

    def stamp(parts: int) -> Column:
        return (done + step * parts).cast("long")

    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), e.alias("sequence"),
        done.cast("long").alias("completion_ns"),
        F.when(e % 13 == 0, F.lit(0)).otherwise(stamp(2)).cast("long").alias("wakeup_ns"),
        stamp(3).alias("ownership_ns"),
        F.when(e % 7 == 0, done - 5).otherwise(stamp(4)).cast("long").alias("session_ns"),
        stamp(5).alias("enqueue_ns"), stamp(7).alias("start_ns"), stamp(29).alias("line_done_ns"),
        F.lit(WIDTH).alias("record_count"), F.floor(e / 900).cast("long").alias("dropped_buffer_count"),
        (F.floor(e / 400) * 3).cast("long").alias("missed_trigger_count"))


BATCHES = """batches AS (
  SELECT 'u' || user_id AS session_id, event_id AS sequence, done AS completion_ns,
         CASE WHEN event_id % 13 = 0 THEN 0 ELSE done + step * 2 END AS wakeup_ns, done + step * 3 AS ownership_ns,
         CASE WHEN event_id % 7 = 0 THEN done - 5 ELSE done + step * 4 END AS session_ns, done + step * 5 AS enqueue_ns,
         done + step * 7 AS start_ns, done + step * 29 AS line_done_ns,
         event_id // 900 AS dropped_buffer_count, (event_id // 400) * 3 AS missed_trigger_count
  FROM (SELECT *, event_id * 5000000 + 1000000000 AS done, CAST(round(value * 1000e0) AS BIGINT) AS step FROM events))"""
STAGE_SQL = """stamped AS (
  SELECT session_id, sequence, completion_ns AS t0, greatest(wakeup_ns, completion_ns) AS t1,
         greatest(ownership_ns, wakeup_ns, completion_ns) AS t2,
         greatest(session_ns, ownership_ns, wakeup_ns, completion_ns) AS t3,
         greatest(enqueue_ns, session_ns, ownership_ns, wakeup_ns, completion_ns) AS t4,
         greatest(start_ns, enqueue_ns, session_ns, ownership_ns, wakeup_ns, completion_ns) AS t5,
         greatest(line_done_ns, start_ns, enqueue_ns, session_ns, ownership_ns, wakeup_ns, completion_ns) AS t6
  FROM batches),
latency AS (
  SELECT session_id, sequence, (t6 - t0) * 1e-6 AS end_to_end_ms, (t2 - t0) * 1e-6 AS ownership_ms,
         (t6 - t2) * 1e-6 AS signal_ms, (t1 - t0) * 1e-6 AS acquisition_wakeup_ms,
         (t2 - t1) * 1e-6 AS digitizer_materialization_ms, (t3 - t2) * 1e-6 AS session_validation_ms,
         (t4 - t3) * 1e-6 AS enqueue_dispatch_ms, (t5 - t4) * 1e-6 AS queue_wait_ms, (t6 - t5) * 1e-6 AS compute_ms
  FROM stamped)"""
