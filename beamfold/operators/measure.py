"""Records to calibrated measurements and points: the production path."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from beamfold.functions.geometry import to_xyz
from beamfold.functions.kernels import peak_pair
from beamfold.functions.signal import beat_frequency, calibrate, intensity, range_velocity
from beamfold.operators.records import BATCH_KEYS, batch_faults, contract_reason, with_config
from beamfold.session import stage


def with_peaks(records: DataFrame) -> DataFrame:
    """Add ``up_peak`` and ``down_peak`` structs; ``cfg`` holds each row's processing parameters.

    Packed ``payload`` rows are preferred over ``samples`` arrays: they cross into Python as one copy.
    """
    source = "payload" if "payload" in records.columns else "samples"
    peaks = peak_pair(
        F.col(source), F.col("sample_format"), F.col("up_segment"), F.col("down_segment"),
        F.col("cfg.fft_length"), F.col("cfg.window_function"), F.col("cfg.remove_dc"), F.col("cfg.invert_down"),
        F.col("cfg.peak_start"), F.col("cfg.peak_end"), F.col("cfg.threshold_db"),
    )
    return (
        records.withColumn("_peaks", peaks).drop("samples", "payload")
        .withColumn("up_peak", F.col("_peaks.up")).withColumn("down_peak", F.col("_peaks.down")).drop("_peaks")
    )


def with_measurement(peaked: DataFrame) -> DataFrame:
    """Add range, velocity, validity and the Cartesian point from two peaks and ``cfg``."""
    both = F.col("up_peak.valid") & F.col("down_peak.valid")
    tones = [
        beat_frequency(F.col(f"{side}_peak.peak_bin"), F.col("sample_rate_hz"), F.col("cfg.fft_length"))
        for side in ("up", "down")
    ]
    distance, velocity = range_velocity(
        *tones, F.col("cfg.sweep_bandwidth_hz"), F.col("cfg.sweep_rate_hz"), F.col("cfg.wavelength_nm"))
    return (
        peaked.withColumn("measurement_valid", both)
        .withColumn("distance_m", F.when(both, calibrate(
            distance, F.col("cfg.distance_scale"), F.col("cfg.distance_offset_m"))))
        .withColumn("velocity_mps", F.when(both, calibrate(
            velocity, F.col("cfg.velocity_scale"), F.col("cfg.velocity_offset_mps"))))
        .withColumn("intensity_db", F.when(both, intensity(
            F.col("up_peak.magnitude_db"), F.col("down_peak.magnitude_db"))))
        .withColumn("point", to_xyz(F.col("distance_m"), F.col("velocity_mps"), F.col("intensity_db"),
                                    F.col("pos"), F.col("cfg")))
    )


# What the transform cannot do without; a value that did not decode is NULL and rejects the record.
PARAMETERS = ("fft_length", "window_function", "remove_dc", "invert_down", "peak_start", "peak_end", "threshold_db")


def tag_records(ascans: DataFrame, config: DataFrame) -> DataFrame:
    return with_config(ascans, config).withColumn("reject_reason", contract_reason(ascans.columns, parameters=PARAMETERS))


def measure_tagged(tagged: DataFrame) -> DataFrame:
    good = tagged.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return with_measurement(with_peaks(good)).drop("cfg")


def measure_ascans(ascans: DataFrame, config: DataFrame) -> DataFrame:
    """Measure every record that honours its configuration; one map-only pass over the samples.

    The payload stays in place as long as the configuration is small enough to be sent to it (``with_config``); the samples
    are dropped right behind the transform, so later stages move only scalars.
    """
    return measure_tagged(tag_records(ascans, config))


def measure_batches(ascans: DataFrame, config: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Like ``measure_ascans``, but one bad record rejects its whole buffer: (measurements, rejected buffers).

    A buffer is also rejected if it has more records than its configuration's ``records_per_buffer`` (where the configuration has
    that column), or other ones than its records declare. The samples are read once and never shuffle: bad records pass
    the transform with their payload withheld, the scalar rows behind it are written once, and the verdict on a buffer and both
    outputs come from these.
    """
    tagged = tag_records(ascans, config)
    source = "payload" if "payload" in ascans.columns else "samples"
    withheld = tagged.withColumn(source, F.when(F.col("reject_reason").isNull(), F.col(source)))
    judged = stage(with_peaks(withheld), "peaks")
    limit = F.max("cfg.records_per_buffer") if "records_per_buffer" in config.columns else F.lit(None).cast("int")
    faults = batch_faults(judged).withColumnRenamed("reject_reason", "_batch")
    verdict = judged.groupBy(*BATCH_KEYS).agg(
        F.count("reject_reason").alias("bad_records"), F.min("reject_reason").alias("_record"), F.count(F.lit(1)).alias("_n"), limit.alias("_limit"))
    verdict = verdict.join(faults, BATCH_KEYS, "left").select(*BATCH_KEYS, "bad_records", F.coalesce(
        F.when(F.col("_n") > F.col("_limit"), F.lit("record_count")), "_batch", "_record").alias("reject_reason"))
    rejected = verdict.where("reject_reason is not null")
    kept = judged.drop("reject_reason").join(rejected.select(*BATCH_KEYS), BATCH_KEYS, "left_anti")
    return with_measurement(kept).drop("cfg"), rejected
