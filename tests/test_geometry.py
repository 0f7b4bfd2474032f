import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from beamfold.functions import frames
from beamfold.functions.geometry import POINT_FIELDS
from beamfold.operators import clouds, raster, trajectory
from tests.scenes import config

CLOUD = ("session_id string, arrival long, scan_frame_index long, revision long, width int, height int, complete boolean, "
         "points array<struct<x:double,y:double,z:double,intensity:double,velocity:double,scan_x:double,scan_y:double,valid:boolean>>")


def point(x=None, y=0.0, z=0.0):
    return (x, y, z, -20.0, 1.0, 0.0, 0.0, True) if x is not None else (None,) * 7 + (False,)


def cloud(spark, frames, width, height):
    rows = [("s", i, index, revision, width, height, True, points) for i, (index, revision, points) in enumerate(frames)]
    return spark.createDataFrame(rows, CLOUD)


def fused(df, history):
    cells = raster.unfold_cloud(clouds.fusion_sessions(df, span=2))
    return clouds.temporal_fusion(cells, history=history)


def wave(spark):
    xs = [-1.0, -1 / 3, 1 / 3, 1.0, 1.0, 1 / 3, -1 / 3, -1.0]
    rows = [("w", i, x, -1.0 if i < 4 else 1.0, i in (0, 4), i in (0, 4)) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "waveform_id string, idx long, x double, y double, trigger boolean, logical_trigger boolean")


def test_trajectory_mapping(spark):
    scan = spark.createDataFrame(
        [("w", 200000.0, 100000.0, True, -9.0, 9.0, -4.0, 4.0, 2)],
        "waveform_id string, sweep_rate_hz double, sample_rate_hz double, bidirectional boolean, x_start_deg double, "
        "x_end_deg double, y_start_deg double, y_end_deg double, y_line_count int")
    lines = spark.createDataFrame([("s", i, "w", 8) for i in range(2)],
                                  "session_id string, line_sequence long, waveform_id string, record_count int")
    assert trajectory.check_marker_count(wave(spark), scan).first().ok
    placed = trajectory.trajectory_lines(lines, wave(spark), scan)
    records = lines.select("session_id", "line_sequence", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("record_index_in_buffer"))
    rows = {(r.line_sequence, r.record_index_in_buffer): r.pos
            for r in trajectory.map_trajectory(records, placed, wave(spark), scan).collect()}
    assert rows[0, 0].trajectory_sample_index == rows[0, 1].trajectory_sample_index == 0  # zero-order hold
    assert [rows[0, r].x_index for r in range(8)] == list(range(8))
    assert [rows[1, r].x_index for r in range(8)] == list(range(7, -1, -1))
    assert (rows[0, 0].x_angle_deg, rows[0, 7].x_angle_deg) == (-9.0, 9.0)
    assert (rows[0, 0].y_angle_deg, rows[1, 0].y_angle_deg) == (4.0, -4.0)
    assert rows[0, 0].fast_axis == "x" and rows[1, 0].direction == "decreasing"


def test_shift_and_edges_wrap_around(spark):
    shifted = trajectory.shift_trigger(wave(spark), -1)
    assert sorted(r.idx for r in shifted.where("trigger").collect()) == [3, 7]
    assert sorted(r.idx for r in shifted.where("logical_trigger").collect()) == [0, 4]
    always = wave(spark).withColumn("trigger", F.lit(True))
    assert trajectory.rising_edges(always).where("edge").count() == 0
    assert {r.idx for r in trajectory.rising_edges(shifted).where("edge").collect()} == {3, 7}


def test_resample_counts_and_last_point(spark):
    source = wave(spark).withColumn("sample_rate_hz", F.lit(40000.0))
    rows = trajectory.resample_waveform(source)[0].orderBy("idx").collect()
    assert len(rows) == 20 and rows[-1].x == -1.0
    assert math.isclose(rows[1].x, -1 + (2 / 3) * 0.4)
    same, none = trajectory.resample_waveform(source.withColumn("sample_rate_hz", F.lit(100000.0)))
    assert same.select("idx", "x", "trigger").orderBy("idx").collect() == source.select("idx", "x", "trigger").orderBy("idx").collect()
    assert none.count() == 0
    for rate, requested, reason in ((4e6, 0, "point_count"), (1.0, 800000, "point_count"), (0.0, None, "sample_rate"), (float("nan"), None, "sample_rate"), (None, None, "sample_rate")):
        points, rejects = trajectory.resample_waveform(source.withColumn("sample_rate_hz", F.lit(rate).cast("double")))
        assert points.count() == 0
        assert [tuple(r)[1:] for r in rejects.collect()] == [(8, requested, reason)]
    mixed = source.withColumn("sample_rate_hz", F.when(F.col("idx") < 4, 40000.0).otherwise(50000.0))
    assert [r.reject_reason for r in trajectory.resample_waveform(mixed)[1].collect()] == ["sample_rate"]


def test_long_waveform_at_the_playback_rate_stays(spark):
    long = spark.range(16000).select(F.lit("w").alias("waveform_id"), F.col("id").alias("idx"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"),
                                     (F.col("id") % 100 == 0).alias("trigger"), F.lit(100000.0).alias("sample_rate_hz"))
    points, rejects = trajectory.resample_waveform(long)
    assert points.count() == 16000 and points.where("x <> idx").count() == 0 and rejects.count() == 0


MEASURED = ("session_id string, frame_id long, pos struct<x_index:int,y_index:int,valid:boolean>, "
            "up_peak struct<peak_bin:double,magnitude_db:double,valid:boolean>, down_peak struct<peak_bin:double,magnitude_db:double,valid:boolean>, "
            "measurement_valid boolean, distance_m double, velocity_mps double, "
            "point struct<x:double,y:double,z:double,intensity:double,velocity:double,scan_x:double,scan_y:double,valid:boolean>, "
            "host_timestamp_ns long, config_revision long")


def measured(spark, count, width=2, height=2, valid=True):
    peak = (1.0, -20.0, valid)
    rows = [
        ("s", i, ((i - 1) % width, (i - 1) // width % height, True), peak, peak, valid, 1.0 if valid else None, 0.0,
         point(float(i)) if valid else point(), i, 1)
        for i in range(1, count + 1)
    ]
    return spark.createDataFrame(rows, MEASURED)


@pytest.mark.parametrize("count,latest", [(2, None), (4, 0), (6, 0), (8, 1)])
def test_only_complete_rasters_are_published(spark, count, latest):
    rows = raster.scan_frame_index(measured(spark, count), width=2, span=3)
    newest = raster.latest_snapshot(raster.assemble_cloud(rows, 2, 2)).collect()
    assert [r.scan_frame_index for r in newest] == ([] if latest is None else [latest])
    frames, incomplete = raster.raster_frames_by_id(measured(spark, count), 2, 2)
    assert frames.count() == count // 4 and incomplete.count() == (count % 4 > 0)
    assert incomplete.where("dropped").count() == 0


def test_invalid_measurement_still_completes_a_frame(spark):
    rows = measured(spark, 1, 1, 1, valid=False).withColumn("scan_frame_index", F.lit(0).cast("long"))
    frame = raster.assemble_bscan(rows, 1, 1).first()
    assert frame.depth == [None] and frame.valid == [False]


def test_last_write_wins_and_lines_need_every_cell(spark):
    rows = measured(spark, 4).withColumn("scan_frame_index", F.lit(0).cast("long"))
    again = rows.where("frame_id = 2").withColumn("frame_id", F.lit(9).cast("long")).withColumn("distance_m", F.lit(7.0))
    line = raster.assemble_lines(rows.unionByName(again), 2).where("y_index = 0").first()
    assert line.distance_m == [1.0, 7.0] and line.last_frame_id == 9
    assert raster.assemble_lines(rows.where("frame_id <> 2"), 2).count() == 1


def test_median_fusion_fills_holes(spark):
    frames = [(0, 1, [point(1.0), point(2.0)]), (1, 1, [point(1.2), point()])]
    rows = {(r.ord, r.x_index): r for r in fused(cloud(spark, frames, 2, 1), 3).collect()}
    assert math.isclose(rows[1, 0].point.x, 1.1) and rows[1, 1].point.x == 2.0
    assert (rows[1, 0].temporal_observations, rows[1, 1].temporal_observations) == (2, 1)
    assert sum(r.source_valid for (o, _), r in rows.items() if o == 1) == 1


def test_history_ages_out_and_resets(spark):
    frames = [(0, 1, [point(1.0)])] + [(i, 1, [point()]) for i in (1, 2, 3)]
    rows = {r.ord: r.temporal_observations for r in fused(cloud(spark, frames, 1, 1), 3).collect()}
    assert rows == {0: 1, 1: 1, 2: 1, 3: 0}
    back = [(5, 1, [point(1.0)]), (0, 1, [point(3.0)]), (1, 2, [point(4.0)])]
    again = {r.ord: (r.fusion_session, r.temporal_observations, r.point.x) for r in fused(cloud(spark, back, 1, 1), 3).collect()}
    assert [again[i][1] for i in range(3)] == [1, 1, 1] and [again[i][2] for i in range(3)] == [1.0, 3.0, 4.0]


def test_fusion_across_chunk_edges(spark, monkeypatch):
    monkeypatch.setattr(clouds, "FUSION_CHUNK", 4)
    frames = [(i, 1, [point(float(i))]) for i in range(11)]
    rows = {r.ord: r for r in fused(cloud(spark, frames, 1, 1), 5).collect()}
    for i in range(11):
        window = list(range(max(0, i - 4), i + 1))
        middle = (window[(len(window) - 1) // 2] + window[len(window) // 2]) / 2
        assert rows[i].point.x == middle and rows[i].temporal_observations == len(window)


@pytest.mark.parametrize("history,factor", [(1, 1), (2, 2), (3, 4), (5, 4)])
def test_whole_frames_fuse_and_densify_like_rows_of_cells(spark, history, factor):
    import random

    rng = random.Random(history)

    def cell():
        kind = rng.random()
        if kind < 0.2:
            return point()
        row = list(point(3 + rng.random() * 0.1, rng.random() * 0.05, rng.random() * 0.1))
        if kind < 0.3:
            row[rng.randrange(7)] = rng.choice([float("nan"), None, float("inf")])
        return tuple(row)

    frames = [(i % 6, 1, [cell() for _ in range(12)]) for i in range(15)]
    df = cloud(spark, frames, 3, 4).unionAll(cloud(spark, [(0, 1, [cell()])], 1, 1).withColumn("session_id", F.lit("one")))
    numbered = clouds.fusion_sessions(df, span=4)
    rows = clouds.temporal_fusion(raster.unfold_cloud(numbered), history=history)
    fused_rows = clouds.fuse_clouds(numbered, history=history)
    columns = ["session_id", "fusion_session", "ord", "x_index", "y_index", "source_valid", "temporal_observations", "point"]
    plain = lambda d, names: sorted((tuple(r) for r in d.select(*names).collect()), key=repr)
    assert plain(clouds.fused_cells(fused_rows), columns) == plain(rows, columns)
    columns += ["display_y", "display_height", "interpolated"]
    a, b = (plain(d, columns) for d in (clouds.densify_clouds(fused_rows, factor=factor), clouds.interpolate_rows(rows, factor=factor)))
    assert len(a) == len(b)
    for r, s in zip(sorted(a, key=lambda r: (r[:5], r[8])), sorted(b, key=lambda r: (r[:5], r[8]))):
        assert r[:7] + r[8:] == s[:7] + s[8:] and r[7].valid == s[7].valid and all(p == q or abs(p - q) < 1e-12 for p, q in zip(r[7], s[7]))


@pytest.mark.parametrize("column,height,inserted", [
    ([point(10.0, 0.0, -0.1), point(10.0, 0.0, 0.1)], 5, 3),
    ([point(1.0), point(10.0)], 5, 0),
    ([point(3.0, 0.0, 0.02 * i) for i in range(12)], 45, 33),
])
def test_vertical_densifying(spark, column, height, inserted):
    cells = fused(cloud(spark, [(0, 1, column)], 1, len(column)), 1)
    shown = clouds.interpolate_rows(cells, factor=9)
    counts = clouds.cloud_counts(shown).first()
    assert (counts.display_height, counts.interpolated_points, counts.fused_points) == (height, inserted, len(column))
    if inserted == 3:
        assert abs(shown.where("display_y = 2").first().point.z) < 1e-12


def test_malformed_clouds_are_refused(spark):
    assert clouds.fusion_sessions(cloud(spark, [(0, 1, [point(1.0)] * 3)], 2, 2)).count() == 0


def test_bounds_of_nothing(spark):
    empty = raster.unfold_cloud(cloud(spark, [(0, 1, [point()])], 1, 1)).withColumn("ord", F.lit(0))
    row = clouds.cloud_bounds(empty).first()
    assert (row.center_x, row.center_y, row.center_z, row.extent) == (0.0, 0.0, 0.0, 1.0)


def test_replay_positions_outside_the_raster_are_rejected(spark):
    rows = spark.createDataFrame([(1, 3, 1, True), (2, 4, 0, True), (3, 9, 9, False)], "frame_id long, x int, y int, ok boolean")
    names = ("x_command", "y_command", "x_angle_deg", "y_angle_deg")
    pos = F.struct(
        F.col("x").alias("x_index"), F.col("y").alias("y_index"), F.lit(0).cast("long").alias("trajectory_sample_index"),
        *[F.lit(0.5).alias(n) for n in names], *[F.lit("x").alias(n) for n in ("fast_axis", "direction", "source")],
        F.lit(True).alias("angle_calibrated"), F.col("ok").alias("valid"))
    df = rows.select("frame_id", F.lit(1).cast("long").alias("config_revision"), pos.alias("pos"))
    good, bad = trajectory.align_replay(df, config(spark))
    assert {r.frame_id: r.pos.x_angle_deg for r in good.collect()} == {1: 9.0, 3: 3.0}
    assert [r.frame_id for r in bad.collect()] == [2]


def test_frame_kernels_work_on_bounded_runs():
    """What a task holds depends on frames, not on the size of Spark's Arrow batch."""
    def point(frame, cell):
        return {n: 1.0 + (frame * 7 + cell + i) % 13 for i, n in enumerate(POINT_FIELDS)} | {"valid": (frame + cell) % 5 > 0}

    clouds = [[point(f, c) for c in range(100)] for f in range(1000)]
    kind = pa.struct([*((n, pa.float64()) for n in POINT_FIELDS), ("valid", pa.bool_())])
    history = pa.array([[clouds[f], clouds[f - 1]] if f % 3 else [clouds[f]] for f in range(1000)], pa.list_(pa.list_(kind)))[1:]
    fused = list(frames.fuse_frames.func(iter([history, history[:0]])))
    assert 1 < len(fused) and max(len(run.flatten()) for run in fused) <= frames.CELLS_AT_ONCE
    whole = pa.concat_arrays(fused)
    assert len(whole) == 999 and whole.equals(frames._fused(history))
    width, factor = pa.array([10] * 999, pa.int32()), pa.array([4] * 999, pa.int32())
    shown = list(frames.densify_frames.func(iter([(whole, width, factor)])))
    assert 1 < len(shown) and pa.concat_arrays(shown).equals(frames._densified(whole, width, factor))
