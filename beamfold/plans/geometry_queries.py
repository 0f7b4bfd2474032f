"""Queries of sections E, F and G: positions, raster assembly, cloud post-processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beamfold.functions.geometry import edge_gate, index_to_angle
from beamfold.operators import clouds as G, raster, trajectory as E
from beamfold.plans.catalog import query, r6, sql6, with_ctes
from beamfold.plans.tables import (ASCANS, CELLS, CFG, EDGES, HEIGHT, POSITIONS, WAVEFORMS, WIDTH, ascans, cells, config,
                                   table, waveforms)

SPAN = 2000  # small chunks, so that chunk edges are exercised at every scale


def filled(column: str | Column, missing: float = -999.0) -> Column:
    return r6(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(missing)))


def sqlf(expression: str, name: str) -> str:
    return sql6(f"coalesce({expression}, -999e0)", name)


def position_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "session_id", "frame_id", "pos.x_index", "pos.y_index", "pos.direction", "pos.source",
        *[r6(f"pos.{n}").alias(n) for n in ("x_command", "y_command", "x_angle_deg", "y_angle_deg")])


@query("E1_stamp_raster", with_ctes(CFG, ASCANS, POSITIONS, select=f"""
SELECT session_id, frame_id, CAST(x_index AS INTEGER) AS x_index, CAST(y_index AS INTEGER) AS y_index,
       CASE WHEN bidirectional AND y_index % 2 = 1 THEN 'decreasing' ELSE 'increasing' END AS direction,
       'generated_raster' AS source, {sql6("x_command", "x_command")}, {sql6("y_command", "y_command")},
       {sql6("x_angle_deg", "x_angle_deg")}, {sql6("y_angle_deg", "y_angle_deg")} FROM posed"""))
def e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return position_rows(E.stamp_raster(ascans(spark, sf_dir), config(spark, sf_dir)))


@query("E2_index_to_angle", f"""
SELECT p_partkey, {sqlf("CASE WHEN n >= 2 AND i < n THEN -9e0 + 18e0 * (i / (n - 1e0)) END", "angle")}
FROM (SELECT p_partkey, p_partkey % 40 AS i, p_size % 30 AS n FROM part)""")
def e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = index_to_angle(F.col("p_partkey") % 40, F.col("p_size") % 30, F.lit(-9.0), F.lit(9.0))
    return table(spark, sf_dir, "part").select("p_partkey", filled(angle).alias("angle"))


def stored_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which two in three carry a stored position, some outside the raster."""
    f = F.col("frame_id")
    stored = F.struct(
        (f % 12).cast("int").alias("x_index"), (f % 6).cast("int").alias("y_index"),
        f.alias("trajectory_sample_index"), (f / 300.0).alias("x_command"), (f / -300.0).alias("y_command"),
        F.lit(0.0).alias("x_angle_deg"), F.lit(0.0).alias("y_angle_deg"), F.lit("y").alias("fast_axis"),
        F.lit("unknown").alias("direction"), F.lit("mcu_trajectory").alias("source"),
        F.lit(True).alias("angle_calibrated"), (f % 3 != 0).alias("valid"))
    return ascans(spark, sf_dir).withColumn("pos", stored)


@query("E3_align_replay", with_ctes(CFG, ASCANS, POSITIONS, """aligned AS (
  SELECT session_id, frame_id, CASE WHEN frame_id % 3 <> 0 THEN frame_id % 12 ELSE x_index END AS x,
         CASE WHEN frame_id % 3 <> 0 THEN frame_id % 6 ELSE y_index END AS y,
         CASE WHEN frame_id % 3 <> 0 THEN frame_id / 300e0 ELSE x_command END AS xc FROM posed)""", select=f"""
SELECT session_id, frame_id, CAST(x AS INTEGER) AS x_index, CAST(y AS INTEGER) AS y_index, {sql6("xc", "x_command")},
       {sqlf("CASE WHEN x < 10 AND y < 5 THEN -9e0 + 18e0 * (x / 9e0) END", "x_angle_deg")},
       {sqlf("CASE WHEN x < 10 AND y < 5 THEN 4e0 - 8e0 * (y / 4e0) END", "y_angle_deg")},
       CASE WHEN x < 10 AND y < 5 THEN 'ok' ELSE 'outside_raster' END AS verdict FROM aligned"""))
def e3(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = E.align_replay(stored_positions(spark, sf_dir), config(spark, sf_dir))

    def rows(df: DataFrame, verdict: Column) -> DataFrame:
        angle = {n: F.when(F.col("pos.valid"), F.col(f"pos.{n}")) for n in ("x_angle_deg", "y_angle_deg")}
        return df.select("session_id", "frame_id", "pos.x_index", "pos.y_index", r6("pos.x_command").alias("x_command"),
                         *[filled(c).alias(n) for n, c in angle.items()], verdict.alias("verdict"))

    return rows(good, F.lit("ok")).unionByName(rows(bad, F.col("reject_reason")))


RESAMPLED = """counted AS (SELECT *, count(*) OVER (PARTITION BY waveform_id) AS n FROM waveforms),
targets AS (
  SELECT DISTINCT waveform_id, n, sample_rate_hz, CAST(round_even(n * 1e5 / sample_rate_hz, 0) AS BIGINT) AS m FROM counted),
grid AS (
  SELECT waveform_id, n, sample_rate_hz, t, t * sample_rate_hz / 1e5 AS p
  FROM targets, LATERAL (SELECT unnest(range(m)) AS t) WHERE m BETWEEN 2 AND 15000),
placed_grid AS (
  SELECT *, least(CAST(floor(p) AS BIGINT), n - 1) AS lower_idx, least(CAST(floor(p) AS BIGINT) + 1, n - 1) AS upper_idx,
         CASE WHEN floor(p) >= n - 1 THEN n - 1 ELSE least(CAST(round_even(p, 0) AS BIGINT), n - 1) END AS marker_idx
  FROM grid)"""


@query("E4_resample_waveform", with_ctes(WAVEFORMS, RESAMPLED, select=f"""
SELECT g.waveform_id, g.t AS idx, {sql6("CASE WHEN lower_idx = n - 1 THEN a.x ELSE a.x + (b.x - a.x) * (p - lower_idx) END", "x")},
       {sql6("CASE WHEN lower_idx = n - 1 THEN a.y ELSE a.y + (b.y - a.y) * (p - lower_idx) END", "y")}, m.trigger AS trigger
FROM placed_grid g JOIN waveforms a ON a.waveform_id = g.waveform_id AND a.idx = lower_idx
JOIN waveforms b ON b.waveform_id = g.waveform_id AND b.idx = upper_idx
JOIN waveforms m ON m.waveform_id = g.waveform_id AND m.idx = marker_idx"""))
def e4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = E.resample_waveform(waveforms(spark, sf_dir))
    return out.select("waveform_id", "idx", r6("x").alias("x"), r6("y").alias("y"), "trigger")


@query("E4_rejects", with_ctes(WAVEFORMS, """rated AS (SELECT waveform_id, n, CASE CAST(waveform_id AS INTEGER) % 6 WHEN 1 THEN rate * 1e5 WHEN 2 THEN rate / 1e4 WHEN 3 THEN 0e0
    WHEN 4 THEN NULL WHEN 5 THEN 1e5 ELSE rate END AS rate
  FROM (SELECT waveform_id, count(*) AS n, min(sample_rate_hz) AS rate FROM waveforms GROUP BY waveform_id)),
judged AS (SELECT *, CASE WHEN rate > 0 THEN CAST(round_even(n * 1e5 / rate, 0) AS BIGINT) END AS m FROM rated)""", select="""
SELECT waveform_id, n AS source_points, m AS requested_points, CASE WHEN m IS NULL THEN 'sample_rate' ELSE 'point_count' END AS reject_reason
FROM judged WHERE m IS NULL OR (rate <> 1e5 AND m NOT BETWEEN 2 AND 15000)"""))
def e4_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rates that are too high, too low, zero or missing, by the waveform's number.
    k, rate = F.col("waveform_id").cast("int") % 6, F.col("sample_rate_hz")
    spoiled = F.when(k == 1, rate * 1e5).when(k == 2, rate / 1e4).when(k == 3, F.lit(0.0)).when(
        k == 4, F.lit(None).cast("double")).when(k == 5, F.lit(1e5)).otherwise(rate)
    return E.resample_waveform(waveforms(spark, sf_dir).withColumn("sample_rate_hz", spoiled))[1]


@query("E5_rising_edges", with_ctes(WAVEFORMS, EDGES, select="SELECT waveform_id, idx, edge FROM edges"))
def e5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.rising_edges(waveforms(spark, sf_dir)).select("waveform_id", "idx", "edge")


@query("E6_shift_trigger", with_ctes(WAVEFORMS, select=f"""
SELECT w.waveform_id, w.idx, {sql6("w.x", "x")}, s.trigger, w.logical_trigger
FROM waveforms w JOIN (SELECT waveform_id, ((idx - 37) % n + n) % n AS idx, trigger FROM
  (SELECT *, count(*) OVER (PARTITION BY waveform_id) AS n FROM waveforms)) s USING (waveform_id, idx)"""))
def e6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.shift_trigger(waveforms(spark, sf_dir), -37).select(
        "waveform_id", "idx", r6("x").alias("x"), "trigger", "logical_trigger")


@query("E9_waveform_summary", with_ctes(WAVEFORMS, EDGES, select=f"""
SELECT waveform_id, count(*) AS point_count, CAST(sum(CAST(edge AS INTEGER)) AS BIGINT) AS marker_rising_edges,
       {sql6("max(sample_rate_hz)", "source_sample_rate_hz")}, abs(max(sample_rate_hz) - 1e5) >= 1e-9 AS resampled,
       {sql6("min(x)", "minimum_x_command")}, {sql6("max(x)", "maximum_x_command")},
       {sql6("min(y)", "minimum_y_command")}, {sql6("max(y)", "maximum_y_command")} FROM edges GROUP BY waveform_id"""))
def e9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.waveform_summary(waveforms(spark, sf_dir))
    numbers = [c for c in out.columns if c.endswith(("_command", "_rate_hz"))]
    return out.withColumns({c: r6(c) for c in numbers})


def scan_of_waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_waveform = waveforms(spark, sf_dir).groupBy("waveform_id").agg(F.max("sample_rate_hz").alias("sample_rate_hz"))
    return per_waveform.select(
        "waveform_id", "sample_rate_hz", F.lit(150000.0).alias("sweep_rate_hz"),
        (F.col("waveform_id").cast("int") % 2 == 1).alias("bidirectional"), F.lit(-9.0).alias("x_start_deg"),
        F.lit(9.0).alias("x_end_deg"), F.lit(-4.0).alias("y_start_deg"), F.lit(4.0).alias("y_end_deg"),
        F.lit(200).alias("y_line_count"))


def lines_of_waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight lines per waveform, of 40 records each (a single one every third line)."""
    ids = waveforms(spark, sf_dir).select("waveform_id").distinct()
    rows = ids.select("waveform_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("line_sequence"))
    return rows.select(
        F.concat(F.lit("w"), "waveform_id").alias("session_id"), F.col("line_sequence").cast("long").alias("line_sequence"),
        "waveform_id",
        F.when(F.col("line_sequence") % 3 == 2, 1).otherwise(40).alias("record_count"))


LINES = """marked AS (
  SELECT waveform_id, idx AS marker_index, row_number() OVER (PARTITION BY waveform_id ORDER BY idx) - 1 AS marker_no,
         count(*) OVER (PARTITION BY waveform_id) AS marker_count FROM edges WHERE edge),
sizes AS (SELECT waveform_id, count(*) AS points, max(sample_rate_hz) AS rate FROM waveforms GROUP BY waveform_id),
lines AS (
  SELECT 'w' || s.waveform_id AS session_id, l AS line_sequence, s.waveform_id, points, rate,
         CASE WHEN l % 3 = 2 THEN 1 ELSE 40 END AS record_count, m.marker_no AS y_index, m.marker_index,
         CASE WHEN CAST(s.waveform_id AS INTEGER) % 2 = 1 AND m.marker_no % 2 = 1 THEN 'decreasing' ELSE 'increasing' END AS direction
  FROM sizes s, range(8) AS g(l), marked m WHERE m.waveform_id = s.waveform_id AND m.marker_no = l % m.marker_count),
ends AS (
  SELECT l.*, abs(b.x - a.x) AS dx, abs(b.y - a.y) AS dy FROM lines l
  JOIN waveforms a ON a.waveform_id = l.waveform_id AND a.idx = marker_index % points
  JOIN waveforms b ON b.waveform_id = l.waveform_id
   AND b.idx = (marker_index + CAST(floor((record_count - 1) * rate / 150000e0) AS BIGINT)) % points),
axes AS (
  SELECT *, CASE WHEN record_count <= 1 OR greatest(dx, dy) <= 1e-9 THEN 'unknown' WHEN dx >= dy THEN 'x' ELSE 'y' END AS fast_axis
  FROM ends)"""


@query("E10_trajectory_lines", with_ctes(WAVEFORMS, EDGES, LINES, select="""
SELECT session_id, line_sequence, y_index, marker_index, direction, fast_axis FROM axes"""))
def e10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.trajectory_lines(lines_of_waveforms(spark, sf_dir), waveforms(spark, sf_dir), scan_of_waveforms(spark, sf_dir))
    return out.select("session_id", "line_sequence", "y_index", "marker_index", "direction", "fast_axis")


@query("E11_map_trajectory", with_ctes(WAVEFORMS, EDGES, LINES, """mapped AS (
  SELECT *, (marker_index + CAST(floor(r * rate / 150000e0) AS BIGINT)) % points AS i,
         CASE WHEN direction = 'decreasing' THEN record_count - 1 - r ELSE r END AS xi
  FROM axes, range(40) AS g(r) WHERE r < record_count)""", select=f"""
SELECT session_id, line_sequence, CAST(r AS INTEGER) AS record_index_in_buffer, CAST(xi AS INTEGER) AS x_index,
       CAST(y_index AS INTEGER) AS y_index, i AS trajectory_sample_index, {sql6("x", "x_command")}, {sql6("y", "y_command")},
       {sqlf("CASE WHEN record_count >= 2 THEN -9e0 + 18e0 * (xi / (record_count - 1e0)) END", "x_angle_deg")},
       {sqlf("CASE WHEN y_index < 200 THEN 4e0 - 8e0 * (y_index / 199e0) END", "y_angle_deg")}, fast_axis
FROM mapped m JOIN waveforms w ON w.waveform_id = m.waveform_id AND w.idx = m.i"""))
def e11(spark: SparkSession, sf_dir: str) -> DataFrame:
    scan, wave = scan_of_waveforms(spark, sf_dir), waveforms(spark, sf_dir)
    base = lines_of_waveforms(spark, sf_dir)
    records = base.select(
        "session_id", "line_sequence",
        F.explode(F.sequence(F.lit(0), F.col("record_count") - 1)).alias("record_index_in_buffer"))
    out = E.map_trajectory(records, E.trajectory_lines(base, wave, scan), wave, scan)
    return out.select(
        "session_id", "line_sequence", "record_index_in_buffer", "pos.x_index", "pos.y_index",
        "pos.trajectory_sample_index", r6("pos.x_command").alias("x_command"), r6("pos.y_command").alias("y_command"),
        filled("pos.x_angle_deg").alias("x_angle_deg"), filled("pos.y_angle_deg").alias("y_angle_deg"), "pos.fast_axis")


@query("E12_line_sequence", """
SELECT 's' || (l_orderkey % 8) AS session_id, l_orderkey AS dma_buffer_sequence, l_linenumber, l_partkey,
       dense_rank() OVER (PARTITION BY l_orderkey % 8 ORDER BY l_orderkey) - 1 AS line_sequence FROM lineitem""")
def e12(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), (F.col("l_orderkey") % 8).cast("string")).alias("session_id"),
        F.col("l_orderkey").alias("dma_buffer_sequence"), "l_linenumber", "l_partkey")
    return E.line_sequence(records)


@query("E13_check_marker_count", with_ctes(WAVEFORMS, EDGES, select="""
SELECT waveform_id, CAST(sum(CAST(edge AS INTEGER)) AS BIGINT) AS emitted_markers,
       CAST(sum(CAST(logical_edge AS INTEGER)) AS BIGINT) AS logical_markers,
       sum(CAST(edge AS INTEGER)) = 200 AND sum(CAST(logical_edge AS INTEGER)) = 200 AS ok FROM edges GROUP BY waveform_id"""))
def e13(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.check_marker_count(waveforms(spark, sf_dir), scan_of_waveforms(spark, sf_dir))
    return out.select("waveform_id", "emitted_markers", "logical_markers", "ok")


@query("F1_scan_frame_index", with_ctes(CELLS, """seen AS (
  SELECT *, lag(y_index) OVER s AS prev_y, row_number() OVER s - 1 AS rn FROM cells WHERE located
  WINDOW s AS (PARTITION BY session_id ORDER BY frame_id)),
runs AS (SELECT *, max(CASE WHEN prev_y IS NULL OR prev_y <> y_index THEN rn END) OVER (PARTITION BY session_id ORDER BY frame_id) AS run
         FROM seen),
places AS (SELECT *, (rn - run) % 10 AS place FROM runs),
progress AS (
  SELECT *, coalesce(sum(CASE WHEN place = 9 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY frame_id
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM places)""", select="""
SELECT session_id, frame_id, CAST(sum(CASE WHEN place = 0 AND y_index = 0 AND done > 0 THEN 1 ELSE 0 END)
         OVER (PARTITION BY session_id ORDER BY frame_id) AS BIGINT) AS scan_frame_index FROM progress"""))
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = raster.discard_out_of_grid(cells(spark, sf_dir).drop("scan_frame_index"), WIDTH, HEIGHT)
    return raster.scan_frame_index(points, width=WIDTH, span=SPAN).select("session_id", "frame_id", "scan_frame_index")


FULL_LINES = """full_lines AS (SELECT session_id, scan_frame_index, y_index FROM cells WHERE located GROUP BY ALL HAVING count(DISTINCT x_index) = 10),
full_frames AS (SELECT session_id, scan_frame_index FROM cells WHERE located GROUP BY ALL HAVING count(DISTINCT (y_index, x_index)) = 50)"""


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.discard_out_of_grid(cells(spark, sf_dir), WIDTH, HEIGHT)


@query("F2_assemble_lines", with_ctes(CELLS, FULL_LINES, select=f"""
SELECT c.session_id, c.scan_frame_index, c.y_index, c.x_index, {sqlf("CASE WHEN up_ok THEN o_totalprice / 29979.2458e0 END", "up_index")},
       {sqlf("CASE WHEN down_ok THEN -(o_orderkey % 40) END", "down_db")}, {sqlf("CASE WHEN both_ok THEN o_totalprice / 299792.458e0 END", "distance_m")},
       {sqlf("px", "depth_m")}, CASE WHEN up_ok THEN 'detected' ELSE 'invalid' END AS up_state, both_ok AS valid
FROM cells c JOIN full_lines l ON c.session_id = l.session_id AND c.scan_frame_index = l.scan_frame_index AND c.y_index = l.y_index"""))
def f2(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = raster.assemble_lines(located(spark, sf_dir), WIDTH)
    zipped = F.arrays_zip("up_index", "down_db", "distance_m", "depth_m", "up_state", "valid")
    rows = lines.select(*raster.LINE_KEYS, F.posexplode(zipped).alias("x_index", "c"))
    return rows.select(
        *raster.LINE_KEYS, "x_index", *[filled(f"c.{n}").alias(n) for n in ("up_index", "down_db", "distance_m", "depth_m")],
        "c.up_state", "c.valid")


FRAME_CELLS = """frame_cells AS (
  SELECT c.* FROM cells c JOIN full_frames f ON c.session_id = f.session_id AND c.scan_frame_index = f.scan_frame_index)"""


@query("F3_assemble_bscan", with_ctes(CELLS, FULL_LINES, FRAME_CELLS, select=f"""
SELECT session_id, scan_frame_index, max(frame_id) OVER (PARTITION BY session_id, scan_frame_index) AS last_frame_id,
       CAST(y_index * 10 + x_index AS INTEGER) AS cell, {sqlf("px", "depth")}, both_ok AS valid FROM frame_cells"""))
def f3(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = raster.assemble_bscan(located(spark, sf_dir), WIDTH, HEIGHT)
    rows = frames.select(*raster.FRAME_KEYS, "last_frame_id", F.posexplode(F.arrays_zip("depth", "valid")).alias("cell", "c"))
    return rows.select(*raster.FRAME_KEYS, "last_frame_id", "cell", filled("c.depth").alias("depth"), "c.valid")


CLOUD_ROWS = f"""
SELECT session_id, scan_frame_index, y_index, x_index, shown AS valid, {sqlf("px", "x")}, {sqlf("py", "y")}, {sqlf("pz", "z")},
       {sqlf("pi", "intensity")}, {sqlf("pv", "velocity")} FROM frame_cells"""


def cloud_rows(clouds: DataFrame) -> DataFrame:
    return raster.unfold_cloud(clouds).select(
        *raster.FRAME_KEYS, "y_index", "x_index", "point.valid",
        *[filled(f"point.{n}").alias(n) for n in ("x", "y", "z", "intensity", "velocity")])


@query("F4_assemble_cloud", with_ctes(CELLS, FULL_LINES, FRAME_CELLS, select=f"""
SELECT session_id, scan_frame_index, max(frame_id) AS last_frame_id, CAST(count(*) AS INTEGER) AS points,
       count(*) FILTER (shown) AS valid_points, {sql6("sum(coalesce(px, 0) * (y_index * 10 + x_index + 1))", "checksum")}
FROM frame_cells GROUP BY ALL"""))
def f4(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = raster.assemble_cloud(located(spark, sf_dir), WIDTH, HEIGHT)
    weighted = F.transform("points", lambda p, i: F.coalesce(p["x"], F.lit(0.0)) * (i + 1))
    return frames.select(
        *raster.FRAME_KEYS, "last_frame_id", F.size("points").alias("points"),
        F.size(F.filter("points", lambda p: p["valid"])).cast("long").alias("valid_points"),
        r6(F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v)).alias("checksum"))


@query("F5_latest_snapshot", with_ctes(CELLS, FULL_LINES, FRAME_CELLS, select=f"""
SELECT session_id, max(scan_frame_index) AS scan_frame_index, {sql6("sum(coalesce(px, 0))", "depth_sum")}
FROM frame_cells f WHERE scan_frame_index = (SELECT max(scan_frame_index) FROM frame_cells g WHERE g.session_id = f.session_id)
GROUP BY session_id"""))
def f5(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = raster.latest_snapshot(raster.assemble_bscan(located(spark, sf_dir), WIDTH, HEIGHT))
    total = F.aggregate("depth", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return newest.select("session_id", "scan_frame_index", r6(total).alias("depth_sum"))


@query("F6_raster_frames_by_id", with_ctes(CELLS, FULL_LINES, FRAME_CELLS, select=f"""
SELECT session_id, scan_frame_index + 1 AS raster_frame_id, max(host_timestamp_ns) AS timestamp_ns, max(config_revision) AS config_revision,
       CAST(count(*) FILTER (shown) AS INTEGER) AS point_count, {sql6("sum(coalesce(px, 0))", "x_sum")} FROM frame_cells GROUP BY ALL"""))
def f6(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, _ = raster.raster_frames_by_id(cells(spark, sf_dir), WIDTH, HEIGHT)
    return frames.select(
        "session_id", "raster_frame_id", "timestamp_ns", "config_revision", F.size("points").alias("point_count"),
        r6(F.aggregate("points", F.lit(0.0), lambda a, p: a + p["x"])).alias("x_sum"))


@query("F6_incomplete_rasters", with_ctes(CELLS, select="""
SELECT session_id, scan_frame_index + 1 AS raster_frame_id, count(DISTINCT (y_index, x_index)) AS filled,
       scan_frame_index < (SELECT max(scan_frame_index) FROM cells d WHERE d.session_id = c.session_id AND located) AS dropped
FROM cells c WHERE located GROUP BY session_id, scan_frame_index HAVING count(DISTINCT (y_index, x_index)) < 50"""))
def f6_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.raster_frames_by_id(cells(spark, sf_dir), WIDTH, HEIGHT)[1]


@query("F7_discard_out_of_grid", with_ctes(CELLS, select="""
SELECT session_id, frame_id FROM cells WHERE located AND x_index < 8 AND y_index < 4"""))
def f7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.discard_out_of_grid(cells(spark, sf_dir), 8, 4).select("session_id", "frame_id")


@query("F8_unfold_cloud", with_ctes(CELLS, FULL_LINES, FRAME_CELLS, select=CLOUD_ROWS))
def f8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cloud_rows(raster.assemble_cloud(located(spark, sf_dir), WIDTH, HEIGHT))


def arriving_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete clouds in arrival order; the frame counter wraps every 30 frames, the revision steps every 40."""
    clouds = raster.assemble_cloud(located(spark, sf_dir), WIDTH, HEIGHT)
    return clouds.select(
        "session_id", F.col("scan_frame_index").alias("arrival"), (F.col("scan_frame_index") % 30).alias("scan_frame_index"),
        F.floor(F.col("scan_frame_index") / 40).cast("long").alias("revision"), "width", "height", "complete", "points")


FUSION = """heads AS (
  SELECT session_id, arrival, (arrival % 30 <= lag(arrival % 30) OVER s) OR (arrival // 40 <> lag(arrival // 40) OVER s)
         OR lag(arrival) OVER s IS NULL AS reset, row_number() OVER s - 1 AS ord
  FROM (SELECT DISTINCT session_id, scan_frame_index AS arrival FROM frame_cells)
  WINDOW s AS (PARTITION BY session_id ORDER BY arrival)),
fusion AS (
  SELECT session_id, arrival, ord, CAST(sum(CASE WHEN reset THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY arrival) AS BIGINT)
         AS fusion_session FROM heads)"""
FUSED = "fused AS (SELECT f.session_id, f.fusion_session, f.ord, c.y_index, c.x_index, c.shown AS source_valid,\n" + ",\n".join(
    f"quantile_cont(c.{source}, 0.5) OVER h AS {name}" for source, name in
    (("px", "x"), ("py", "y"), ("pz", "z"), ("pi", "intensity"), ("pv", "velocity"), ("psx", "scan_x"), ("psy", "scan_y"))
) + """, count(c.px) OVER h AS seen
  FROM frame_cells c JOIN fusion f ON c.session_id = f.session_id AND c.scan_frame_index = f.arrival
  WINDOW h AS (PARTITION BY f.session_id, f.fusion_session, c.y_index, c.x_index ORDER BY f.ord ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""
FUSION_CTES = (CELLS, FULL_LINES, FRAME_CELLS, FUSION, FUSED)
POINT_NUMBERS = ("x", "y", "z", "intensity", "velocity", "scan_x", "scan_y")


def fused_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fuse_clouds(G.fusion_sessions(arriving_clouds(spark, sf_dir), span=32), history=3)


def fused_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fused_cells(fused_clouds(spark, sf_dir))


@query("G1_finite_points", with_ctes(CELLS, select="SELECT session_id, frame_id FROM cells WHERE shown AND o_custkey % 9 <> 0"))
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.round(F.col("point.intensity") * -50).cast("long") % 9 == 0, F.lit(float("nan"))).otherwise(
        F.col("point.velocity"))
    rows = cells(spark, sf_dir).withColumn("point", F.col("point").withField("velocity", broken))
    return G.finite_points(rows).select("session_id", "frame_id")


@query("G2_fusion_sessions", with_ctes(*FUSION_CTES[:4], select="SELECT session_id, arrival, fusion_session, ord FROM fusion"))
def g2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.fusion_sessions(arriving_clouds(spark, sf_dir), span=32).select("session_id", "arrival", "fusion_session", "ord")


@query("G3_temporal_fusion", with_ctes(*FUSION_CTES, select=f"""
SELECT session_id, fusion_session, ord, y_index, x_index, source_valid, CAST(seen AS INTEGER) AS temporal_observations,
       {', '.join(sqlf(n, n) for n in POINT_NUMBERS)} FROM fused"""))
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_cells(spark, sf_dir).select(
        "session_id", "fusion_session", "ord", "y_index", "x_index", "source_valid", "temporal_observations",
        *[filled(f"point.{n}").alias(n) for n in POINT_NUMBERS])


GATE = """sqrt(a.x * a.x + a.y * a.y + a.z * a.z) AS ra, sqrt(b.x * b.x + b.y * b.y + b.z * b.z) AS rb,
         a.x * b.x + a.y * b.y + a.z * b.z AS dot"""
DISPLAY = ("""pairs AS (SELECT a.session_id, a.ord, a.x_index, a.y_index, a.seen AS sa, b.seen AS sb, """
           + ", ".join(f"a.{n} AS a_{n}, b.{n} AS b_{n}" for n in POINT_NUMBERS) + ", " + GATE + """
  FROM fused a JOIN fused b ON a.session_id = b.session_id AND a.ord = b.ord AND a.x_index = b.x_index AND b.y_index = a.y_index + 1
  WHERE a.x IS NOT NULL AND b.x IS NOT NULL),
gated AS (
  SELECT * FROM pairs WHERE ra > 0 AND rb > 0
   AND abs(ra - rb) <= greatest(0.05e0, 3e0 * least(ra, rb) * acos(greatest(-1e0, least(1e0, dot / (ra * rb)))))),
display AS (
  SELECT session_id, ord, x_index, y_index * 4 AS display_y, false AS interpolated, source_valid, seen, """
           + ", ".join(POINT_NUMBERS) + """ FROM fused UNION ALL
  SELECT session_id, ord, x_index, y_index * 4 + s, true, false, least(sa, sb), """
           + ", ".join(f"a_{n} + (b_{n} - a_{n}) * (s / 4e0)" for n in POINT_NUMBERS) + """
  FROM gated, range(1, 4) AS g(s))""")


def display_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.densify_clouds(fused_clouds(spark, sf_dir), factor=4)


@query("G4_interpolate_rows", with_ctes(*FUSION_CTES, DISPLAY, select=f"""
SELECT session_id, ord, x_index, CAST(display_y AS INTEGER) AS display_y, interpolated, CAST(seen AS INTEGER) AS temporal_observations,
       {', '.join(sqlf(n, n) for n in POINT_NUMBERS)} FROM display"""))
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display_cells(spark, sf_dir).select(
        "session_id", "ord", "x_index", "display_y", "interpolated", "temporal_observations",
        *[filled(f"point.{n}").alias(n) for n in POINT_NUMBERS])


@query("G5_edge_gate", f"""
SELECT o_orderkey, ra > 0 AND rb > 0 AND abs(ra - rb) <= greatest(0.05e0, 3e0 * least(ra, rb) *
         acos(greatest(-1e0, least(1e0, dot / (ra * rb))))) AS joined
FROM (SELECT a.o_orderkey, {GATE} FROM
  (SELECT o_orderkey, o_totalprice / 1e5 AS x, (o_custkey % 10) / 10e0 AS y, 0.1e0 AS z FROM orders) a JOIN
  (SELECT o_orderkey, o_totalprice / 1e5 + (o_orderkey % 20) / 50e0 AS x, (o_custkey % 7) / 10e0 AS y, 0.15e0 AS z FROM orders) b
  USING (o_orderkey))""")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    def point(x: Column, y: Column, z: float) -> Column:
        rest = [F.lit(0.0).alias(n) for n in ("intensity", "velocity", "scan_x", "scan_y")]
        return F.struct(x.alias("x"), y.alias("y"), F.lit(z).alias("z"), *rest, F.lit(True).alias("valid"))

    x = F.col("o_totalprice") / 1e5
    a = point(x, (F.col("o_custkey") % 10) / F.lit(10.0), 0.1)
    b = point(x + (F.col("o_orderkey") % 20) / F.lit(50.0), (F.col("o_custkey") % 7) / F.lit(10.0), 0.15)
    return table(spark, sf_dir, "orders").select("o_orderkey", edge_gate(a, b).alias("joined"))


@query("G6_cloud_counts", with_ctes(*FUSION_CTES, DISPLAY, select="""
SELECT session_id, ord, count(*) FILTER (NOT interpolated AND source_valid) AS source_valid_points,
       count(*) FILTER (NOT interpolated AND x IS NOT NULL) AS fused_points, count(*) FILTER (interpolated) AS interpolated_points,
       count(*) FILTER (x IS NOT NULL) AS displayed_points, 5 AS source_height, 17 AS display_height FROM display GROUP BY ALL"""))
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cloud_counts(display_cells(spark, sf_dir))


@query("G7_cloud_bounds", with_ctes(CELLS, select=f"""
SELECT session_id, scan_frame_index,
       {', '.join(sql6(f"coalesce(0.5e0 * (min({p}) + max({p})), 0e0)", f"center_{a}") for a, p in (("x", "px"), ("y", "py"), ("z", "pz")))},
       {sql6("CASE WHEN min(px) IS NULL THEN 1e0 ELSE greatest(max(px) - min(px), max(py) - min(py), max(pz) - min(pz), 1e-4) END", "extent")}
FROM cells GROUP BY session_id, scan_frame_index"""))
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = G.cloud_bounds(cells(spark, sf_dir), keys=("session_id", "scan_frame_index"))
    return out.withColumns({c: r6(c) for c in out.columns if c.startswith(("center", "extent"))})


@query("G8_color_value", with_ctes(CELLS, select=f"""
SELECT session_id, frame_id, mode, {sql6("(v - min(v) OVER f) / greatest(max(v) OVER f - min(v) OVER f, 1e-6)", "color_value")}
FROM (SELECT session_id, scan_frame_index, frame_id, 'intensity' AS mode, pi AS v FROM cells WHERE shown UNION ALL
      SELECT session_id, scan_frame_index, frame_id, 'velocity', pv FROM cells WHERE shown UNION ALL
      SELECT session_id, scan_frame_index, frame_id, 'range', sqrt(px * px + py * py + pz * pz) FROM cells WHERE shown)
WINDOW f AS (PARTITION BY session_id, scan_frame_index, mode)"""))
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, parts = cells(spark, sf_dir), []
    for mode in ("intensity", "velocity", "range"):
        part = G.color_value(points, mode=mode, keys=("session_id", "scan_frame_index"))
        parts.append(part.select("session_id", "frame_id", F.lit(mode).alias("mode"), r6("color_value").alias("color_value")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
