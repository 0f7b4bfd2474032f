"""Point-cloud post-processing: fusion over frames, vertical densifying, counts, bounds, colour values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from beamfold.functions.frames import densify_frames, fuse_frames
from beamfold.functions.geometry import POINT_FIELDS, edge_gate, finite_point, point_range
from beamfold.operators.ordered import Series, previous, running_sum
from beamfold.session import stage

MAXIMUM_HISTORY = 5
# Frames per fusion chunk; each chunk repeats the history-1 frames before it.
FUSION_CHUNK = 1024
CELL_KEYS = ["session_id", "fusion_session", "x_index", "y_index"]


def finite_points(points: DataFrame) -> DataFrame:
    return points.where(finite_point(F.col("point")))


def well_formed(clouds: DataFrame) -> DataFrame:
    ok = (F.col("complete") & (F.col("width") > 0) & (F.col("height") > 0)
          & (F.size("points") == F.col("width") * F.col("height")))
    return clouds.where(F.coalesce(ok, F.lit(False)))


def _numbered(heads: DataFrame, span: int) -> DataFrame:
    """(session_id, arrival, fusion_session, ord) of staged frame headers."""
    series = Series(("session_id",), ("arrival",), span)
    watched = ("scan_frame_index", "width", "height", "revision")
    heads = previous(heads, series, {f"_p_{c}": c for c in watched})
    changed = F.col("_p_scan_frame_index").isNull() | (F.col("scan_frame_index") <= F.col("_p_scan_frame_index"))
    for name in watched[1:]:
        changed = changed | (F.col(name) != F.col(f"_p_{name}"))
    heads = stage(heads.select("session_id", "arrival", changed.cast("long").alias("_reset")), "cloud-heads")
    # The ordinal is a running count, so both numbers come from one pass.
    heads = running_sum(heads, series, {"fusion_session": F.col("_reset"), "_count": F.lit(1)})
    return heads.select("session_id", "arrival", "fusion_session", (F.col("_count") - 1).cast("long").alias("ord"))


def fusion_sessions(clouds: DataFrame, *, span: int = 1 << 15) -> DataFrame:
    """Add ``fusion_session`` and ``ord`` to well-formed clouds in arrival order.

    History restarts when the frame index does not advance or the geometry or revision changes. The clouds are written once;
    only their headers are ordered, and the two numbers join back by (session, arrival).
    """
    clouds = stage(well_formed(clouds), "clouds")
    heads = clouds.select("session_id", "arrival", "scan_frame_index", "width", "height", "revision")
    return clouds.join(_numbered(heads, span), ["session_id", "arrival"])


def fuse_clouds(clouds: DataFrame, *, history: int = 1) -> DataFrame:
    """``temporal_fusion`` of whole frames (with fusion_session and ord): ``points`` become fused cells in the same order, with
    ``source_valid`` and ``temporal_observations``.

    A frame meets the few before it in its own row; one exchange moves whole frames, and medians are taken over all cells at once.
    """
    depth = max(1, min(MAXIMUM_HISTORY, history))
    chunk = F.floor(F.col("ord") / FUSION_CHUNK).cast("long")
    halo = F.col("ord") % FUSION_CHUNK >= FUSION_CHUNK - (depth - 1)
    rows = clouds.withColumn("_chunk", F.explode(F.array_compact(F.array(chunk, F.when(halo, chunk + 1)))))
    window = Window.partitionBy("session_id", "fusion_session", "_chunk").orderBy("ord")
    frames = F.array_compact(F.array("points", *(F.lag("points", k).over(window) for k in range(1, depth))))
    rows = rows.withColumn("_frames", frames).where(F.col("_chunk") == chunk)
    return rows.withColumn("points", fuse_frames("_frames")).drop("_chunk", "_frames")


def _point() -> Column:
    return F.struct(*(F.col(f"_c.{n}").alias(n) for n in (*POINT_FIELDS, "valid"))).alias("point")


def fused_cells(fused: DataFrame) -> DataFrame:
    """Rows of cells of ``fuse_clouds``, as ``temporal_fusion`` gives them."""
    kept = [c for c in fused.columns if c != "points"]
    rows = fused.select(*kept, F.posexplode("points").alias("cell", "_c"))
    return rows.select(
        *kept, "cell", F.expr("cast(cell div width as int)").alias("y_index"), (F.col("cell") % F.col("width")).cast("int").alias("x_index"), _point(),
        "_c.source_valid", "_c.temporal_observations")


def densify_clouds(fused: DataFrame, *, factor: int = 1) -> DataFrame:
    """``interpolate_rows`` of the whole frames of ``fuse_clouds``, without an exchange: rows of the cells on display."""
    steps = interpolation_factor(factor)
    kept = [c for c in fused.columns if c != "points"]
    shown = densify_frames(F.col("points"), F.col("width").cast("int"), F.lit(steps))
    rows = fused.select(*kept, F.explode(shown).alias("_c"))
    scale = F.when(F.col("height") > 1, F.lit(steps)).otherwise(F.lit(1))
    return rows.select(
        *kept, ((F.col("height") - 1) * scale + 1).alias("display_height"), "_c.x_index", "_c.y_index", "_c.display_y", _point(), "_c.source_valid",
        "_c.temporal_observations", "_c.interpolated")


def _median(values: Column) -> Column:
    """Median of a short array; the mean of the middle two for an even count."""
    ranked, count = F.sort_array(values), F.size(values)
    low, high = F.floor((count + 1) / 2).cast("int"), F.floor(count / 2).cast("int") + 1
    return F.when(count > 0, F.lit(0.5) * (F.element_at(ranked, low) + F.element_at(ranked, high)))


def temporal_fusion(cells: DataFrame, *, history: int = 1) -> DataFrame:
    """Median of each field per cell over the last ``history`` complete frames.

    Rows: session_id, fusion_session, ord, x_index, y_index, point; every frame has a row per
    cell. Windows run per (cell, frame chunk) with the few preceding frames repeated into the
    chunk, so a small raster observed for years still spreads over many tasks.
    """
    depth = max(1, min(MAXIMUM_HISTORY, history))
    kept = F.struct(*[F.col(f"point.{n}").cast("double").alias(n) for n in POINT_FIELDS])
    rows = cells.withColumn("_v", F.when(finite_point(F.col("point")), kept))
    chunk = F.floor(F.col("ord") / FUSION_CHUNK).cast("long")
    halo = F.col("ord") % FUSION_CHUNK >= FUSION_CHUNK - (depth - 1)
    copies = F.array_compact(F.array(chunk, F.when(halo, chunk + 1)))
    rows = rows.withColumn("_chunk", F.explode(copies))
    window = Window.partitionBy(*CELL_KEYS, "_chunk").orderBy("ord").rowsBetween(-(depth - 1), 0)
    rows = rows.withColumn("_seen", F.collect_list("_v").over(window)).where(F.col("_chunk") == chunk)
    count = F.size("_seen")

    def median_of(name: str) -> Column:
        return _median(F.transform("_seen", lambda p: p[name])).alias(name)

    fused = F.struct(*[median_of(name) for name in POINT_FIELDS], (count > 0).alias("valid"))
    return (
        rows.withColumn("source_valid", F.col("_v").isNotNull()).withColumn("temporal_observations", count)
        .withColumn("point", fused).drop("_v", "_seen", "_chunk")
    )


def interpolation_factor(factor: int) -> int:
    return 4 if factor >= 4 else 2 if factor >= 2 else 1


def interpolate_rows(cells: DataFrame, *, factor: int = 1, height: str = "height") -> DataFrame:
    """Insert ``factor - 1`` rows between vertical neighbours that pass the edge gate.

    Adds display_y, interpolated and display_height; a group is one column of one frame.
    """
    steps = interpolation_factor(factor)
    scale = F.when(F.col(height) > 1, F.lit(steps)).otherwise(F.lit(1))
    base = cells.withColumn("display_height", (F.col(height) - 1) * scale + 1)
    column = Window.partitionBy("session_id", "ord", "x_index").orderBy("y_index")
    below = F.lead(F.struct("y_index", "point", "temporal_observations")).over(column)
    base = base.withColumn("_b", F.when(F.col("y_index") + 1 < F.col(height), below))
    joined = F.coalesce((F.col("_b.y_index") == F.col("y_index") + 1), F.lit(False)) & edge_gate(
        F.col("point"), F.col("_b.point"))

    def blended(step: int) -> Column:
        fraction = F.lit(step / steps)
        fields = [
            (F.col(f"point.{n}") + (F.col(f"_b.point.{n}") - F.col(f"point.{n}")) * fraction).alias(n)
            for n in POINT_FIELDS
        ]
        return F.struct(
            (F.col("y_index") * scale + step).cast("int").alias("display_y"),
            F.struct(*fields, F.lit(True).alias("valid")).alias("point"),
            F.least("temporal_observations", "_b.temporal_observations").alias("temporal_observations"),
            F.lit(True).alias("interpolated"),
        )

    original = F.struct(
        (F.col("y_index") * scale).cast("int").alias("display_y"), F.col("point"),
        F.col("temporal_observations"), F.lit(False).alias("interpolated"))
    extra = [F.when(joined, blended(step)) for step in range(1, steps)]
    kept = [c for c in base.columns if c not in ("point", "temporal_observations", "_b")]
    rows = base.select(*kept, F.explode(F.array_compact(F.array(original, *extra))).alias("_r"))
    return rows.select(*kept, "_r.*")


def cloud_counts(cells: DataFrame) -> DataFrame:
    """Per frame: source-valid, fused, interpolated and displayed points and both heights."""
    shown = F.col("point.valid")
    return cells.groupBy("session_id", "ord").agg(
        F.count_if(~F.col("interpolated") & F.col("source_valid")).alias("source_valid_points"),
        F.count_if(~F.col("interpolated") & shown).alias("fused_points"),
        F.count_if(F.col("interpolated") & shown).alias("interpolated_points"),
        F.count_if(shown).alias("displayed_points"),
        F.max("height").alias("source_height"),
        F.max("display_height").alias("display_height"),
    )


def cloud_bounds(points: DataFrame, *, keys: tuple[str, ...] = ("session_id", "ord")) -> DataFrame:
    """Centre and largest span of the valid points of each frame; an empty frame is 0,0,0 with extent 1."""
    stats = points.groupBy(*keys).agg(*[
        function(F.when(F.col("point.valid"), F.col(f"point.{axis}"))).alias(f"_{tag}_{axis}")
        for axis in "xyz" for tag, function in (("lo", F.min), ("hi", F.max))
    ])
    centres = [
        F.coalesce(F.lit(0.5) * (F.col(f"_lo_{a}") + F.col(f"_hi_{a}")), F.lit(0.0)).alias(f"center_{a}") for a in "xyz"
    ]
    extent = F.greatest(*[F.col(f"_hi_{a}") - F.col(f"_lo_{a}") for a in "xyz"], F.lit(1.0e-4))
    empty = F.col("_lo_x").isNull()
    return stats.select(*keys, *centres, F.when(empty, F.lit(1.0)).otherwise(extent).alias("extent"))


def color_value(points: DataFrame, *, mode: str, keys: tuple[str, ...] = ("session_id", "ord")) -> DataFrame:
    """Add ``color_value``: intensity, velocity or range scaled by the frame's own minimum and maximum."""
    value = {"intensity": F.col("point.intensity"), "velocity": F.col("point.velocity"),
             "range": point_range(F.col("point"))}[mode]
    frame = Window.partitionBy(*keys)
    shown = points.where(F.col("point.valid")).withColumn("_v", value)
    low, high = F.min("_v").over(frame), F.max("_v").over(frame)
    return shown.withColumn("color_value", (F.col("_v") - low) / F.greatest(high - low, F.lit(1.0e-6))).drop("_v")
