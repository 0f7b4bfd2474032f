"""Points to lines, complete frames and clouds; organised clouds back to points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from beamfold.operators.ordered import Series, previous, rows_since, running_sum
from beamfold.session import stage

LINE_KEYS = ["session_id", "scan_frame_index", "y_index"]
FRAME_KEYS = ["session_id", "scan_frame_index"]


def discard_out_of_grid(points: DataFrame, width: int, height: int) -> DataFrame:
    """Keep rows whose position is valid and inside the raster."""
    inside = F.col("pos.valid") & F.col("pos.x_index").between(0, width - 1) & F.col("pos.y_index").between(0, height - 1)
    return points.where(F.coalesce(inside, F.lit(False)))


def scan_frame_index(points: DataFrame, *, width: int, span: int = 1 << 17) -> DataFrame:
    """Number raster frames: a line at y = 0 that begins after any completed line opens a new frame.

    A line ends when y changes or when its ``width`` records have passed.
    """
    series = Series(("session_id",), ("frame_id",), span)
    narrow = stage(points.select("session_id", "frame_id", F.col("pos.y_index").alias("_y")), "frame-index")
    narrow = previous(narrow, series, {"_py": "_y"})
    changed = F.col("_py").isNull() | (F.col("_py") != F.col("_y"))
    narrow = rows_since(narrow, series, {"_since": changed})
    place = F.col("_since") % width
    narrow = stage(narrow.select(
        "session_id", "frame_id", ((place == 0) & (F.col("_y") == 0)).alias("_opens"), (place == width - 1).alias("_done")),
        "frame-index")
    # Opening needs any completed line before, so only the session's first completion matters.
    first_done = narrow.where("_done").groupBy("session_id").agg(F.min("frame_id").alias("_first_done"))
    narrow = narrow.join(first_done, "session_id", "left")
    opened = F.coalesce(F.col("_opens") & (F.col("frame_id") > F.col("_first_done")), F.lit(False)).cast("long")
    numbered = running_sum(narrow, series, {"scan_frame_index": opened})
    return points.join(numbered.select("session_id", "frame_id", "scan_frame_index"), ["session_id", "frame_id"])


def frame_index_by_id(frame_id: Column, width: int, height: int) -> Column:
    """Raster number of a regular scan by arithmetic on the one-based frame number."""
    return F.floor(F.greatest(frame_id - 1, F.lit(0)) / (width * height)).cast("long")


CELL_FIELDS = ("up_index", "down_index", "up_db", "down_db", "distance_m", "velocity_mps", "depth_m",
               "up_state", "down_state", "valid")


def _last_cells(measurements: DataFrame) -> DataFrame:
    """Last write per raster cell (map-side combined), flattened to the line fields plus the point."""
    def state(side: str) -> Column:
        return F.when(F.col(f"{side}_peak.valid"), F.lit("detected")).otherwise(F.lit("invalid"))

    cell = F.struct(
        F.col("up_peak.peak_bin").alias("up_index"), F.col("down_peak.peak_bin").alias("down_index"),
        F.col("up_peak.magnitude_db").alias("up_db"), F.col("down_peak.magnitude_db").alias("down_db"),
        F.col("distance_m"), F.col("velocity_mps"), F.col("point.x").alias("depth_m"),
        state("up").alias("up_state"), state("down").alias("down_state"),
        F.col("measurement_valid").alias("valid"), F.col("frame_id"), F.col("point"),
    )
    keyed = measurements.select(
        *FRAME_KEYS, F.col("pos.y_index").alias("y_index"), F.col("pos.x_index").alias("x_index"),
        "frame_id", cell.alias("cell"))
    return keyed.groupBy(*LINE_KEYS, "x_index").agg(F.max_by("cell", "frame_id").alias("cell"))


def _ordered(fields: list[Column]) -> Column:
    return F.sort_array(F.collect_list(F.struct(*fields)))


def assemble_lines(measurements: DataFrame, width: int) -> DataFrame:
    """One row per full line (all ``width`` distinct x), fields as arrays in x order.

    A group holds at most ``width`` cells, because each cell was reduced to its last write first.
    """
    lines = _last_cells(measurements).groupBy(*LINE_KEYS).agg(
        F.count(F.lit(1)).alias("filled"), F.max("cell.frame_id").alias("last_frame_id"),
        _ordered([F.col("x_index"), F.col("cell")]).alias("_cells"))
    full = lines.where(F.col("filled") == width)

    def field(name: str) -> Column:
        return F.transform("_cells", lambda c: c["cell"][name]).alias(name)

    arrays = [field(name) for name in CELL_FIELDS]
    return full.select(*LINE_KEYS, "last_frame_id", *arrays)


def _complete(measurements: DataFrame, width: int, height: int, value: Column) -> DataFrame:
    """Frames with every cell present; ``cells`` in row-major order. A group is one raster at most."""
    cells = _last_cells(measurements)
    frames = cells.groupBy(*FRAME_KEYS).agg(
        F.count(F.lit(1)).alias("filled"), F.max("cell.frame_id").alias("last_frame_id"),
        _ordered([F.col("y_index"), F.col("x_index"), value.alias("v")]).alias("_cells"))
    return frames.where(F.col("filled") == width * height)


def assemble_bscan(measurements: DataFrame, width: int, height: int) -> DataFrame:
    """Complete frames as row-major depth arrays with a validity mask."""
    value = F.struct(F.col("cell.depth_m").alias("depth"), F.col("cell.valid").alias("valid"))
    frames = _complete(measurements, width, height, value)
    return frames.select(
        *FRAME_KEYS, "last_frame_id", F.lit(width).alias("width"), F.lit(height).alias("height"),
        F.transform("_cells", lambda c: c["v"]["depth"]).alias("depth"),
        F.transform("_cells", lambda c: c["v"]["valid"]).alias("valid"))


def assemble_cloud(measurements: DataFrame, width: int, height: int) -> DataFrame:
    """Complete frames as organised row-major point arrays."""
    frames = _complete(measurements, width, height, F.col("cell.point"))
    return frames.select(
        *FRAME_KEYS, "last_frame_id", F.lit(width).alias("width"), F.lit(height).alias("height"),
        F.lit(True).alias("complete"), F.transform("_cells", lambda c: c["v"]).alias("points"))


def latest_snapshot(snapshots: DataFrame, *, by: str = "scan_frame_index") -> DataFrame:
    """The newest row per session (map-side combined, no sort)."""
    packed = F.struct(*[c for c in snapshots.columns if c != "session_id"])
    return snapshots.groupBy("session_id").agg(F.max_by(packed, by).alias("_s")).select("session_id", "_s.*")


def raster_frames_by_id(measurements: DataFrame, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """Packet-side assembly by frame-number arithmetic: complete frames, and counts of the incomplete.

    The newest raster of a session may still be filling; it is incomplete but not dropped.
    """
    inside = discard_out_of_grid(measurements, width, height)
    keyed = inside.select(
        "session_id", frame_index_by_id(F.col("frame_id"), width, height).alias("raster"),
        (F.col("pos.y_index") * width + F.col("pos.x_index")).alias("cell"),
        "frame_id", "host_timestamp_ns", "config_revision", "point")
    cells = keyed.groupBy("session_id", "raster", "cell").agg(
        F.max_by(F.struct("frame_id", "host_timestamp_ns", "config_revision", "point"), "frame_id").alias("c"))
    newest = F.max_by(F.struct("c.host_timestamp_ns", "c.config_revision"), F.col("c.frame_id"))
    rasters = cells.groupBy("session_id", "raster").agg(
        F.count(F.lit(1)).alias("filled"), newest.alias("last"),
        F.sort_array(F.collect_list(F.when(F.col("c.point.valid"), F.struct("cell", "c.point")))).alias("_p"))
    complete = F.col("filled") == width * height
    frames = rasters.where(complete).select(
        "session_id", (F.col("raster") + 1).alias("raster_frame_id"),
        F.col("last.host_timestamp_ns").alias("timestamp_ns"), F.col("last.config_revision").alias("config_revision"),
        F.transform("_p", lambda p: p["point"]).alias("points"))
    final = rasters.groupBy("session_id").agg(F.max("raster").alias("_newest"))
    incomplete = rasters.where(~complete).join(final, "session_id").select(
        "session_id", (F.col("raster") + 1).alias("raster_frame_id"), "filled",
        (F.col("raster") < F.col("_newest")).alias("dropped"))
    return frames, incomplete


def unfold_cloud(clouds: DataFrame) -> DataFrame:
    """Organised grids to one row per cell."""
    kept = [c for c in clouds.columns if c != "points"]
    rows = clouds.select(*kept, F.posexplode("points").alias("cell", "point"))
    return rows.select(
        *kept, "cell", F.floor(F.col("cell") / F.col("width")).cast("int").alias("y_index"),
        (F.col("cell") % F.col("width")).cast("int").alias("x_index"), "point")
