"""Spectra and peaks. Long form: one row per (record, seg, k); array form: one row per segment."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from beamfold.functions.kernels import spectrum_arrays
from beamfold.functions.signal import magnitude_db, parabolic_offset

RECORD_KEYS = ("session_id", "frame_id")
SEGMENT_KEYS = (*RECORD_KEYS, "seg")


def native_spectrum_arrays(values: Column, fft_length: int) -> Column:
    """Direct transform as Catalyst expressions: no shuffle, no explode, for short segments."""
    def part(k: Column, function) -> Column:
        step = F.lit(2.0 * math.pi / fft_length) * k.cast("double")
        return F.aggregate(
            F.transform(values, lambda v, i: v * function(step * i.cast("double"))), F.lit(0.0), lambda a, v: a + v
        )

    bins = F.sequence(F.lit(0), F.lit(fft_length // 2))
    return F.struct(
        F.transform(bins, lambda k: part(k, F.cos)).alias("re"),
        F.transform(bins, lambda k: -part(k, F.sin)).alias("im"),
    )


def spectrum_per_segment(segments: DataFrame, fft_length: int, *, method: str = "arrow") -> DataFrame:
    """Add ``spectrum`` (arrays re, im) to each segment row; segments are zero-padded implicitly.

    ``arrow`` is the fast transform; ``sql`` the direct one in expressions, for segments of at most a hundred samples or so.
    """
    if method == "arrow":
        column = spectrum_arrays(F.col("values"), F.lit(fft_length))
    elif method == "sql":
        column = native_spectrum_arrays(F.col("values"), fft_length)
    else:
        raise ValueError(f"unknown spectrum method: {method}")
    return segments.withColumn("spectrum", column)


def explode_spectrum(per_segment: DataFrame) -> DataFrame:
    kept = [c for c in per_segment.columns if c not in ("spectrum", "values")]
    pairs = F.arrays_zip(F.col("spectrum.re").alias("re"), F.col("spectrum.im").alias("im"))
    return per_segment.select(*kept, F.posexplode(pairs).alias("k", "_z")).select(*kept, "k", "_z.re", "_z.im")


def spectrum(segments: DataFrame, fft_length: int, *, method: str = "arrow") -> DataFrame:
    """Unnormalised real-to-complex bins 0..n/2 of each segment as rows (..., seg, k, re, im)."""
    return explode_spectrum(spectrum_per_segment(segments, fft_length, method=method))


def peak_bin_search(spec: DataFrame, *, start: int, end: int, keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Strongest bin in the inclusive range, lowest bin on ties; segments without a bin there drop out.

    The range filter comes first, and the maximum is combined map-side.
    """
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    best = F.max_by(F.struct("k", "re", "im"), F.struct(power, -F.col("k")))
    return (
        spec.where(F.col("k").between(start, end)).groupBy(*keys)
        .agg(best.alias("_b"), F.max("coherent").alias("coherent"))
        .select(*keys, "coherent", F.col("_b.k").alias("best_bin"),
                magnitude_db(F.col("_b.re"), F.col("_b.im"), F.col("coherent")).alias("best_db"))
    )


def peak_threshold(peaks: DataFrame, *, threshold_db: float) -> DataFrame:
    """Strictly above the threshold or rejected: bin -1, NULL values, state ``invalid``."""
    level = F.col("best_db")
    ok = F.coalesce(~F.isnan(level) & (F.abs(level) < float("inf")) & (level > threshold_db), F.lit(False))
    return peaks.withColumn("valid", ok).select(
        *[c for c in peaks.columns if c not in ("best_bin", "best_db")],
        F.when(F.col("valid"), F.col("best_bin")).otherwise(F.lit(-1)).cast("int").alias("discrete_bin"),
        F.when(F.col("valid"), F.col("best_bin").cast("double")).alias("peak_bin"),
        F.when(F.col("valid"), level).alias("magnitude_db"),
        F.when(F.col("valid"), F.lit("detected")).otherwise(F.lit("invalid")).alias("state"),
        "valid",
    )


def refine_peak(spec: DataFrame, peaks: DataFrame, *, start: int, end: int,
                keys: Sequence[str] = SEGMENT_KEYS) -> DataFrame:
    """Three-point quadratic refinement of peaks strictly inside the search range.

    Only the three bins around each peak survive the join, so just three dB values per segment
    are computed.
    """
    wanted = peaks.where(F.col("valid")).select(*keys, F.col("discrete_bin").alias("_at"))
    near = spec.join(wanted, list(keys)).where(F.abs(F.col("k") - F.col("_at")) <= 1)
    level = magnitude_db(F.col("re"), F.col("im"), F.col("coherent"))
    sides = near.groupBy(*keys).agg(
        F.max(F.when(F.col("k") < F.col("_at"), level)).alias("_left"),
        F.max(F.when(F.col("k") > F.col("_at"), level)).alias("_right"),
    )
    inside = (F.col("discrete_bin") > start) & (F.col("discrete_bin") < end)
    offset = F.when(inside, parabolic_offset(F.col("_left"), F.col("magnitude_db"), F.col("_right")))
    joined = peaks.join(sides, list(keys), "left").withColumn("_offset", offset)
    return joined.select(*[
        F.coalesce(F.col("peak_bin") + F.col("_offset"), F.col("peak_bin")).alias(c) if c == "peak_bin"
        else F.coalesce(F.col("magnitude_db") - F.lit(0.25) * (F.col("_left") - F.col("_right")) * F.col("_offset"),
                        F.col("magnitude_db")).alias(c) if c == "magnitude_db"
        else F.col(c)
        for c in peaks.columns
    ])


def peaks_up_down(peaks: DataFrame, *, keys: Sequence[str] = RECORD_KEYS) -> DataFrame:
    """One row per record with independent ``up`` and ``down`` peak structs."""
    packed = F.struct("discrete_bin", "peak_bin", "magnitude_db", "valid")
    return peaks.groupBy(*keys).agg(*[
        F.max_by(packed, F.when(F.col("seg") == side, F.lit(1))).alias(side) for side in ("up", "down")
    ])


def spectra_for_selected(spec: DataFrame, record_index: int) -> DataFrame:
    """Keep spectra of the selected record only; measurements of the others are unaffected."""
    return spec.where(F.col("record_index_in_buffer") == record_index)


def display_spectrum(spec: DataFrame) -> DataFrame:
    """Array-form spectra without the terminal Nyquist bin."""
    return spec.withColumn("spectrum", F.struct(*[
        F.slice(F.col(f"spectrum.{part}"), 1, F.size(f"spectrum.{part}") - 1).alias(part) for part in ("re", "im")
    ]))
