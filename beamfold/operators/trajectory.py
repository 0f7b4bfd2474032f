"""Scan positions: generated rasters, replay alignment, waveforms and the trajectory join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from beamfold.functions.geometry import index_to_angle, line_to_elevation
from beamfold.operators.ordered import Series, following, ordinal, previous, row_index
from beamfold.operators.records import first_reason, split_by_reason, with_config
from beamfold.session import stage

# Playback rate and point limit of a scan waveform, range below which an axis is still.
WAVEFORM_RATE_HZ = 100000.0
WAVEFORM_MAXIMUM_POINTS = 15000
AXIS_EPSILON = 1.0e-9


def _angles(x: Column, y: Column, width: Column, height: Column) -> tuple[Column, Column]:
    return (
        index_to_angle(x, width, F.col("scan.x_start_deg"), F.col("scan.x_end_deg")),
        line_to_elevation(y, height, F.col("scan.y_start_deg"), F.col("scan.y_end_deg")),
    )


def generated_position(frame_id: Column) -> Column:
    """Raster position of a one-based frame number; expects the struct column ``scan``."""
    width, height = F.col("scan.x_pixel_count"), F.col("scan.y_line_count")
    zero_based = F.greatest(frame_id - 1, F.lit(0))
    y = F.pmod(F.floor(zero_based / width).cast("long"), height.cast("long")).cast("int")
    step = F.pmod(zero_based, width.cast("long")).cast("int")
    reverse = F.col("scan.bidirectional") & (y % 2 == 1)
    x = F.when(reverse, width - 1 - step).otherwise(step).cast("int")
    x_angle, y_angle = _angles(x, y, width, height)
    return F.struct(
        x.alias("x_index"),
        y.alias("y_index"),
        zero_based.cast("long").alias("trajectory_sample_index"),
        (F.lit(-1.0) + F.lit(2.0) * x / (width - 1)).alias("x_command"),
        (F.lit(1.0) - F.lit(2.0) * y / (height - 1)).alias("y_command"),
        x_angle.alias("x_angle_deg"),
        y_angle.alias("y_angle_deg"),
        F.lit("x").alias("fast_axis"),
        F.when(reverse, F.lit("decreasing")).otherwise(F.lit("increasing")).alias("direction"),
        F.lit("generated_raster").alias("source"),
        F.lit(True).alias("angle_calibrated"),
        F.lit(True).alias("valid"),
    )


def stamp_raster(ascans: DataFrame, scan: DataFrame) -> DataFrame:
    """Set ``pos`` from the frame number and the raster of the record's configuration."""
    return with_config(ascans, scan, alias="scan").withColumn("pos", generated_position(F.col("frame_id"))).drop("scan")


def align_replay(ascans: DataFrame, scan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep stored indices and commands, take angles from the current raster; outside it is a reject.

    Records without a valid position first receive the generated one.
    """
    placed = with_config(ascans, scan, alias="scan")
    generated = generated_position(F.col("frame_id"))
    stored_ok = F.coalesce(F.col("pos.valid"), F.lit(False))
    names = ("x_index", "y_index", "trajectory_sample_index", "x_command", "y_command", "fast_axis", "direction")
    placed = placed.withColumn("_g", generated)
    chosen = {n: F.when(stored_ok, F.col(f"pos.{n}")).otherwise(F.col(f"_g.{n}")) for n in names}
    x_angle, y_angle = _angles(
        chosen["x_index"], chosen["y_index"], F.col("scan.x_pixel_count"), F.col("scan.y_line_count"))
    inside = x_angle.isNotNull() & y_angle.isNotNull()
    aligned = F.struct(
        *[chosen[n].alias(n) for n in names[:5]],
        x_angle.alias("x_angle_deg"), y_angle.alias("y_angle_deg"),
        chosen["fast_axis"].alias("fast_axis"), chosen["direction"].alias("direction"),
        F.lit("replay").alias("source"), inside.alias("angle_calibrated"), inside.alias("valid"),
    )
    tagged = placed.withColumn("pos", aligned).drop("_g", "scan")
    return split_by_reason(tagged.withColumn(
        "reject_reason", F.when(~F.col("pos.valid"), F.lit("outside_raster"))))


def _waveform_series() -> Series:
    return Series(("waveform_id",), ("idx",), 1 << 16)


def _point_count(waveform: DataFrame) -> DataFrame:
    return waveform.groupBy("waveform_id").agg((F.max("idx") + 1).cast("long").alias("_n"))


def resample_waveform(waveform: DataFrame, *, src_rate: str = "sample_rate_hz",
                      dst_rate: float = WAVEFORM_RATE_HZ) -> tuple[DataFrame, DataFrame]:
    """Linear x/y and nearest marker at the playback rate, and the waveforms refused: (points, rejects).

    A waveform at the playback rate stays as it is, whatever its length. ``rejects`` has waveform_id, source_points,
    requested_points and reject_reason: ``sample_rate`` (missing, not finite or not positive; points without one rate) or
    ``point_count`` (the resampled length is not 2..15000).

    Each source row emits the output points that start on it, using only itself and its
    successor, so no join on positions is needed.
    """
    ratio = F.try_divide(F.lit(float(dst_rate)), F.col(src_rate))
    rate = F.min(src_rate)
    counted = waveform.groupBy("waveform_id").agg(
        (F.max("idx") + 1).cast("long").alias("_n"), rate.alias("_rate"), (F.count(src_rate) < F.count(F.lit(1))) | (rate != F.max(src_rate)))
    counted = counted.toDF("waveform_id", "_n", "_rate", "_mixed")
    known = ~F.col("_mixed") & (F.col("_rate") > 0) & (F.col("_rate") < float("inf"))
    kept_as_is = F.abs(F.col("_rate") - F.lit(float(dst_rate))) < 1.0e-9
    requested = F.when(kept_as_is, F.col("_n")).otherwise(F.rint(
        F.try_divide(F.col("_n").cast("double") * F.lit(float(dst_rate)), F.col("_rate")))).cast("long")
    counted = counted.withColumn("_m", F.when(known, requested)).withColumn("reject_reason", first_reason([
        (known, "sample_rate"), (kept_as_is | F.col("_m").between(2, WAVEFORM_MAXIMUM_POINTS), "point_count")]))
    rejects = counted.where("reject_reason is not null").select(
        "waveform_id", F.col("_n").alias("source_points"), F.col("_m").alias("requested_points"), "reject_reason")
    paired = following(waveform, _waveform_series(), {"_nx": "x", "_ny": "y", "_nm": "trigger"})
    paired = paired.join(counted.where("reject_reason is null").select("waveform_id", "_n", "_m"), "waveform_id")
    same = F.abs(F.col(src_rate) - F.lit(float(dst_rate))) < 1.0e-9
    final = F.col("idx") == F.col("_n") - 1
    low = F.greatest(F.floor(F.col("idx") * ratio).cast("long") - 1, F.lit(0))
    high = F.when(final, F.col("_m") - 1).otherwise(
        F.least(F.ceil((F.col("idx") + 1) * ratio).cast("long") + 1, F.col("_m") - 1))
    emitted = paired.where(high >= low).withColumn("_t", F.explode(F.sequence(low, high)))
    position = F.when(same, F.col("_t").cast("double")).otherwise(
        F.col("_t").cast("double") * F.col(src_rate) / F.lit(float(dst_rate)))
    emitted = emitted.withColumn("_p", position)
    emitted = emitted.where(F.least(F.floor("_p"), F.col("_n") - 1) == F.col("idx"))
    fraction = F.col("_p") - F.col("idx")
    nearest = F.least(F.rint("_p").cast("long"), F.col("_n") - 1)

    def blend(here: str, there: str) -> Column:
        return F.when(final, F.col(here)).otherwise(F.col(here) + (F.col(there) - F.col(here)) * fraction)

    marker = F.when(final | (nearest == F.col("idx")), F.col("trigger")).otherwise(F.col("_nm"))
    points = emitted.select(
        "waveform_id", F.col("_t").alias("idx"), blend("x", "_nx").alias("x"), blend("y", "_ny").alias("y"),
        marker.alias("trigger"), marker.alias("logical_trigger"), F.lit(float(dst_rate)).alias("sample_rate_hz"),
    )
    return points, rejects


def rising_edges(series: DataFrame, *, marker: str = "trigger") -> DataFrame:
    """Add ``edge``: the marker rises here; row 0 compares with the last row of its waveform."""
    final = series.groupBy("waveform_id").agg(F.max_by(F.col(marker), F.col("idx")).alias("_last"))
    stepped = previous(series, _waveform_series(), {"_prev": marker})
    before = F.coalesce(F.col("_prev"), F.col("_last"))
    return stepped.join(final, "waveform_id").withColumn("edge", F.col(marker) & ~before).drop("_prev", "_last")


def shift_trigger(waveform: DataFrame, shift: int) -> DataFrame:
    """Rotate the trigger column by ``shift`` positions around each period; commands stay."""
    counted = waveform.join(_point_count(waveform), "waveform_id")
    moved = counted.select(
        "waveform_id", F.pmod(F.col("idx") + F.lit(shift), F.col("_n")).alias("idx"), F.col("trigger").alias("_moved"))
    shifted = waveform.join(moved, ["waveform_id", "idx"])
    return shifted.withColumn("trigger", F.col("_moved")).select(*waveform.columns)


def waveform_summary(waveform: DataFrame, *, src_rate: str = "sample_rate_hz") -> DataFrame:
    """Counts, edges, rates, whether playback resamples, and the command ranges."""
    rate = F.max(src_rate)
    return rising_edges(waveform).groupBy("waveform_id").agg(
        F.count(F.lit(1)).alias("point_count"),
        F.sum(F.col("edge").cast("long")).alias("marker_rising_edges"),
        rate.alias("source_sample_rate_hz"),
        (F.abs(rate - F.lit(WAVEFORM_RATE_HZ)) >= 1.0e-9).alias("resampled"),
        F.min("x").alias("minimum_x_command"), F.max("x").alias("maximum_x_command"),
        F.min("y").alias("minimum_y_command"), F.max("y").alias("maximum_y_command"),
    )


def _marked(waveform: DataFrame) -> DataFrame:
    """Both edge columns from one ordered pass, with the waveform's point count.

    A cyclic marker that takes both values has a rising edge, so whether emitted markers exist
    falls out of the same aggregate that finds the wrap-around values.
    """
    ends = waveform.groupBy("waveform_id").agg(
        F.max_by(F.struct("trigger", "logical_trigger"), "idx").alias("_end"), (F.max("idx") + 1).alias("point_count"),
        (F.min("trigger") != F.max("trigger")).alias("has_emitted"))
    stepped = previous(waveform, _waveform_series(), {"_pt": "trigger", "_pl": "logical_trigger"}).join(ends, "waveform_id")
    return stepped.select(
        "waveform_id", "idx", "point_count", "has_emitted",
        (F.col("trigger") & ~F.coalesce("_pt", "_end.trigger")).alias("emitted_edge"),
        (F.col("logical_trigger") & ~F.coalesce("_pl", "_end.logical_trigger")).alias("logical_edge"))


def marker_table(waveform: DataFrame) -> DataFrame:
    """Numbered marker positions per waveform: emitted markers, else the logical ones."""
    used = _marked(waveform).where(F.when(F.col("has_emitted"), F.col("emitted_edge")).otherwise(F.col("logical_edge")))
    used = used.select("waveform_id", F.col("idx").alias("marker_index"), "point_count")
    return row_index(used, Series(("waveform_id",), ("marker_index",), 1 << 16), "marker_no", total="marker_count")


def _sample_index(marker: Column, record: Column, sample_rate: Column, sweep_rate: Column, points: Column) -> Column:
    """Zero-order hold: the waveform sample playing when ``record`` starts."""
    elapsed = F.floor(record.cast("double") * sample_rate / sweep_rate).cast("long")
    return F.pmod(marker.cast("long") + elapsed, points)


def trajectory_lines(lines: DataFrame, waveform: DataFrame, scan: DataFrame) -> DataFrame:
    """Give each line (``session_id, line_sequence, waveform_id, record_count``) its marker, direction, fast axis.

    ``scan`` maps ``waveform_id`` to sweep_rate_hz, sample_rate_hz and bidirectional.
    """
    markers = stage(marker_table(waveform), "markers")
    counts = markers.groupBy("waveform_id").agg(
        F.max("marker_count").alias("marker_count"), F.max("point_count").alias("point_count"))
    placed = lines.join(scan.join(counts, "waveform_id"), "waveform_id")
    placed = placed.withColumn("y_index", F.pmod(F.col("line_sequence"), F.col("marker_count")))
    placed = placed.join(
        markers.select("waveform_id", F.col("marker_no").alias("y_index"), "marker_index"), ["waveform_id", "y_index"])
    reverse = F.col("bidirectional") & (F.col("y_index") % 2 == 1)
    placed = placed.withColumn("direction", F.when(reverse, F.lit("decreasing")).otherwise(F.lit("increasing")))

    def lookup(df: DataFrame, record: Column, tag: str) -> DataFrame:
        index = _sample_index(F.col("marker_index"), record, F.col("sample_rate_hz"), F.col("sweep_rate_hz"),
                              F.col("point_count"))
        commands = waveform.select(
            "waveform_id", F.col("idx").alias("_i"), F.col("x").alias(f"_x{tag}"), F.col("y").alias(f"_y{tag}"))
        return df.withColumn("_i", index).join(commands, ["waveform_id", "_i"]).drop("_i")

    placed = lookup(placed, F.lit(0), "a")
    placed = lookup(placed, F.col("record_count") - 1, "b")
    dx, dy = F.abs(F.col("_xb") - F.col("_xa")), F.abs(F.col("_yb") - F.col("_ya"))
    moving = (F.col("record_count") > 1) & (F.greatest(dx, dy) > AXIS_EPSILON)
    axis = F.when(~moving, F.lit("unknown")).when(dx >= dy, F.lit("x")).otherwise(F.lit("y"))
    return placed.withColumn("fast_axis", axis).drop("_xa", "_xb", "_ya", "_yb")


def map_trajectory(ascans: DataFrame, lines: DataFrame, waveform: DataFrame, scan: DataFrame) -> DataFrame:
    """Position every record on its line by an equi-join on the computed waveform sample.

    ``lines`` comes from ``trajectory_lines``; ``scan`` maps ``waveform_id`` to the angle ranges and
    ``y_line_count``. Records match lines on (session_id, line_sequence).
    """
    line_columns = ["session_id", "line_sequence", "waveform_id", "y_index", "marker_index", "direction", "fast_axis",
                    "record_count", "point_count", "sample_rate_hz", "sweep_rate_hz"]
    geometry = scan.select("waveform_id", F.struct(
        "x_start_deg", "x_end_deg", "y_start_deg", "y_end_deg", "y_line_count").alias("scan"))
    names = {c: f"_l_{c}" for c in line_columns if c not in ("session_id", "line_sequence", "waveform_id")}
    renamed = lines.select(*[F.col(c).alias(names.get(c, c)) for c in line_columns]).join(geometry, "waveform_id")
    placed = ascans.join(renamed, ["session_id", "line_sequence"])
    placed = placed.where(F.col("record_index_in_buffer") < F.col("_l_record_count"))
    placed = placed.withColumn("_i", _sample_index(
        F.col("_l_marker_index"), F.col("record_index_in_buffer"), F.col("_l_sample_rate_hz"),
        F.col("_l_sweep_rate_hz"), F.col("_l_point_count")))
    commands = waveform.select("waveform_id", F.col("idx").alias("_i"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    placed = placed.join(commands, ["waveform_id", "_i"])
    record, count = F.col("record_index_in_buffer"), F.col("_l_record_count")
    x = F.when(F.col("_l_direction") == "decreasing", count - 1 - record).otherwise(record).cast("int")
    y = F.col("_l_y_index").cast("int")
    x_angle, y_angle = _angles(x, y, count, F.col("scan.y_line_count"))
    calibrated = x_angle.isNotNull() & y_angle.isNotNull()
    pos = F.struct(
        x.alias("x_index"), y.alias("y_index"), F.col("_i").cast("long").alias("trajectory_sample_index"),
        F.col("_x").alias("x_command"), F.col("_y").alias("y_command"),
        x_angle.alias("x_angle_deg"), y_angle.alias("y_angle_deg"),
        F.col("_l_fast_axis").alias("fast_axis"), F.col("_l_direction").alias("direction"),
        F.lit("mcu_trajectory").alias("source"), calibrated.alias("angle_calibrated"), calibrated.alias("valid"),
    )
    kept = [c for c in ascans.columns if c != "pos"]
    return placed.select(*kept, pos.alias("pos"))


def line_sequence(ascans: DataFrame) -> DataFrame:
    """Add the zero-based number of the record's buffer in its session."""
    return ordinal(ascans, ["session_id"], "dma_buffer_sequence", "line_sequence")


def check_marker_count(waveform: DataFrame, scan: DataFrame) -> DataFrame:
    """Whether each waveform has exactly ``y_line_count`` logical and emitted markers."""
    counts = _marked(waveform).groupBy("waveform_id").agg(
        F.count_if("emitted_edge").alias("emitted_markers"), F.count_if("logical_edge").alias("logical_markers"))
    joined = counts.join(scan.select("waveform_id", "y_line_count"), "waveform_id")
    ok = (F.col("emitted_markers") == F.col("y_line_count")) & (F.col("logical_markers") == F.col("y_line_count"))
    return joined.withColumn("ok", ok)
