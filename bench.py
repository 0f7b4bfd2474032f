"""Time the headline queries on the driver's tables and print one JSON line.

``full_records`` measures records of the reference workload's size (4992 samples, two 2048-point
transforms, two records per customer) derived from ``customer`` and stored as Parquet, read five times in one job;
``raw_records`` measures raw recordings of such records, ten per customer, each read once, with the fused scan; listing the
parts and judging their headers (``raw_records_planned``) comes before it. Its rate is reported as A-scans per second.
"""

from __future__ import annotations

import json
import os
import sys
import time
from functools import reduce

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T  # noqa: E402

from beamfold.operators.measure import measure_ascans  # noqa: E402
from beamfold.plans import load_catalog  # noqa: E402
from beamfold.plans.fixtures import create  # noqa: E402
from beamfold.plans.tables import config, no_position, table  # noqa: E402
from beamfold.schemas import SIGNED_INT16  # noqa: E402
from beamfold.session import RECOMMENDED_CONF, new_folder  # noqa: E402
from beamfold.sources import recordings as A  # noqa: E402
from beamfold.sources.measured import measure_recordings  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "C9_measure_ascans", "C10_measure_batches", "E11_map_trajectory", "E12_line_sequence", "F1_scan_frame_index",
    "F2_assemble_lines", "F4_assemble_cloud", "F6_raster_frames_by_id", "G3_temporal_fusion", "G4_interpolate_rows",
    "H1_packetize", "H5_reassemble_batch", "H7_drop_stale_frames", "I2_latency_summary", "I3_rolling_percentiles",
    "I5_period_ema", "I7_sequence_gaps", "J1_resolve_config", "J3_typed_config", "J9_stamp_processing_revision",
    "K1_envelope", "K2_finite_runs", "K7_nearest_rank_percentile",
)
LENGTH, SEGMENT, FFT = 4992, 2048, 2048
# The written records are scanned this often in one job, so fixed costs do not hide the rate.
PASSES = 5


def two_tone(key: int) -> np.ndarray:
    """A record with one tone per segment and noise, determined by its key."""
    step = 2.0 * np.pi * np.arange(SEGMENT) / SEGMENT
    noise = np.random.default_rng(key).integers(-300, 300, LENGTH)
    noise[:SEGMENT] += np.round(12000 * np.sin(37 * step + 0.03 * (key % 64))).astype(np.int64)
    noise[LENGTH - SEGMENT:] += np.round(10000 * np.sin(43 * step - 0.03 * (key % 64))).astype(np.int64)
    return noise.astype(np.int16)


@F.arrow_udf(T.BinaryType())
def two_tone_record(key: pa.Array) -> pa.Array:
    return pa.array([two_tone(int(k)).tobytes() for k in key.to_numpy(zero_copy_only=False)], pa.binary())


def full_records(spark: SparkSession) -> tuple[str, int]:
    """Full-size A-scans written once; returns their folder and row count."""
    place = F.col("key") % 5000
    keys = table(spark, SF_DIR, "customer").select(
        F.explode(F.array(F.col("c_custkey") * 2, F.col("c_custkey") * 2 + 1)).alias("key"))
    rows = keys.repartition(int(CPUS) * 4).select(
        (place + 1).alias("frame_id"),
        F.concat(F.lit("s"), F.floor(F.col("key") / 5000).cast("string")).alias("session_id"),
        F.floor(place / 1000).cast("long").alias("dma_buffer_sequence"),
        (place % 1000).cast("int").alias("record_index_in_buffer"), F.lit(0).cast("long").alias("config_revision"),
        no_position().alias("pos"), F.lit("a").alias("channel"), F.lit(SIGNED_INT16).alias("sample_format"),
        F.lit(1e9).alias("sample_rate_hz"), F.lit(LENGTH).alias("record_length"),
        F.struct(F.lit(0).alias("start"), F.lit(SEGMENT).alias("end_excl")).alias("up_segment"),
        F.struct(F.lit(LENGTH - SEGMENT).alias("start"), F.lit(LENGTH).alias("end_excl")).alias("down_segment"),
        two_tone_record(F.col("key")).alias("payload"))
    path = new_folder(spark, "bench")
    rows.write.parquet(path)
    return path, spark.read.parquet(path).count() * PASSES


def raw_records(spark: SparkSession) -> tuple[str, int]:
    """Raw parts of one buffer of 998 full-size records for every 100 customers; returns their folder and record count."""
    folder = new_folder(spark, "recordings")

    def write(batches):
        for batch in batches:
            for number in batch.column("number").to_pylist():
                keys = number * 998 + np.arange(998)
                records = np.zeros(998, np.dtype(A.TABLES[3]))
                records["frame_id"], records["flags"], records["x_index"] = keys + 1, 1, np.arange(998)
                payload = b"".join(two_tone(int(k)).tobytes() for k in keys)
                head = np.zeros(1, np.dtype(A.BLOCK_FIELDS))
                for name, value in dict(
                        magic=A.BLOCK_MAGIC, version=3, header_bytes=A.BLOCK_BYTES + records.nbytes, payload_bytes=len(payload), sequence=number, record_count=998,
                        record_length=LENGTH, sample_rate_hz=1e9, up_end=SEGMENT, down_start=LENGTH - SEGMENT, down_end=LENGTH, post_trigger=LENGTH).items():
                    head[name] = value
                stream = np.zeros(1, np.dtype(A.STREAM_FIELDS))
                stream["magic"], stream["version"], stream["sample_rate_hz"] = b"FMCWRAW3", 3, 1e9
                stream["record_length"], stream["records_per_buffer"] = LENGTH, 998
                create(f"{folder}/s{number}.raw.0000.bin", stream.tobytes() + head.tobytes() + records.tobytes() + payload)
            yield pa.RecordBatch.from_arrays([batch.column("number")], ["number"])

    numbers = table(spark, SF_DIR, "customer").select(F.floor(F.col("c_custkey") / 100).cast("long").alias("number")).distinct()
    return folder, numbers.repartition(int(CPUS) * 4).mapInArrow(write, "number long").count() * 998


def full_config(spark: SparkSession) -> DataFrame:
    return config(spark, SF_DIR).where("config_revision = 0").withColumns({
        "sample_point": F.lit(LENGTH), "up_end": F.lit(SEGMENT), "down_start": F.lit(LENGTH - SEGMENT),
        "down_end": F.lit(LENGTH), "fft_length": F.lit(FFT), "peak_end": F.lit(900), "threshold_db": F.lit(-45.0)})


def timed(df: DataFrame) -> float:
    started = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    path, rows = full_records(spark)
    stored = reduce(DataFrame.unionByName, [spark.read.parquet(path) for _ in range(PASSES)])
    timed(measure_ascans(stored, full_config(spark)))  # starts the Python workers and compiles the plan
    seconds["full_records"] = timed(measure_ascans(stored, full_config(spark)))
    raw, raw_rows = raw_records(spark)
    timed(measure_recordings(spark, raw, full_config(spark))[0])
    started = time.perf_counter()
    measured = measure_recordings(spark, raw, full_config(spark))[0]
    seconds["raw_records_planned"] = time.perf_counter() - started
    seconds["raw_records"] = timed(measured)
    catalog = load_catalog()
    only = sys.argv[1:]
    for name in HEADLINE:
        if only and name not in only:
            continue
        started = time.perf_counter()
        df = catalog.QUERIES[name](spark, SF_DIR)
        timed(df)
        seconds[name] = time.perf_counter() - started
    payload = raw_rows * LENGTH * 2
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": {name: round(value, 3) for name, value in seconds.items()}, "sf": os.path.basename(SF_DIR.rstrip("/"))[2:],
        "cpus": int(CPUS), "ascans": raw_rows, "ascans_per_s": round(raw_rows / seconds["raw_records"]),
        "gb_per_s": round(payload / seconds["raw_records"] / 1e9, 3), "parquet_ascans_per_s": round(rows / seconds["full_records"]),
    }))


if __name__ == "__main__":
    main()
