"""Store of organised clouds, and CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from beamfold.operators.clouds import well_formed
from beamfold.sources.recordings import read_by_session

# Header and column order of the exported table.
CSV_COLUMNS = {
    "x_forward_m": "point.x", "y_left_m": "point.y", "z_up_m": "point.z", "intensity_db": "point.intensity",
    "velocity_mps": "point.velocity", "scan_x_command": "point.scan_x", "scan_y_command": "point.scan_y",
}


def write_clouds(clouds: DataFrame, path: str) -> None:
    """Parquet of complete organised frames; incomplete or mis-sized ones are not stored."""
    well_formed(clouds).write.partitionBy("session_id").parquet(path)


def read_clouds(spark: SparkSession, path: str) -> DataFrame:
    return well_formed(read_by_session(spark, path))


def csv_rows(points: DataFrame) -> DataFrame:
    return points.where(F.col("point.valid")).select(
        *[F.col(source).alias(name) for name, source in CSV_COLUMNS.items()],
        F.col("interpolated").cast("int").alias("display_interpolated"),
        F.col("temporal_observations").cast("int").alias("temporal_observations"))


def export_cloud_csv(points: DataFrame, path: str) -> None:
    """Displayed points as CSV parts with the nine fixed columns."""
    csv_rows(points).write.option("header", "true").csv(path)
