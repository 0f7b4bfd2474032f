"""Window, magnitude and range/velocity expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Physical constant and measurement limits.
SPEED_OF_LIGHT_MPS = 299792458.0
MINIMUM_AMPLITUDE = 1.0e-10
MINIMUM_CURVATURE_DB = 1.0e-6
# Cosine-sum coefficients of each window, constant term first.
WINDOW_TERMS = {
    "hann": (0.5, -0.5),
    "hamming": (0.54, -0.46),
    "blackman": (0.42, -0.5, 0.08),
    "rectangular": (1.0,),
}


def window_weight(function: str, index: Column, length: Column) -> Column:
    """Weight ``index`` of a symmetric window of ``length`` samples."""
    phase = F.lit(2.0 * math.pi) * index.cast("double") / (length - 1).cast("double")
    terms = WINDOW_TERMS[function]
    value = F.lit(terms[0])
    for order, coefficient in enumerate(terms[1:], start=1):
        value = value + F.lit(coefficient) * F.cos(phase * F.lit(float(order)))
    return F.when(length < 2, F.lit(1.0)).otherwise(value)


def magnitude_db(re: Column, im: Column, coherent: Column) -> Column:
    amplitude = F.lit(2.0) * F.sqrt(re * re + im * im) / F.greatest(coherent, F.lit(1.0))
    return F.lit(20.0) * F.log10(F.greatest(amplitude, F.lit(MINIMUM_AMPLITUDE)))


def parabolic_offset(left: Column, centre: Column, right: Column) -> Column:
    """Vertex offset of three neighbouring dB values, NULL where the fit is not a usable peak."""
    curvature = left - F.lit(2.0) * centre + right
    offset = F.lit(0.5) * (left - right) / curvature
    usable = (curvature < F.lit(-MINIMUM_CURVATURE_DB)) & offset.between(-0.5, 0.5)
    return F.when(usable, offset)


def beat_frequency(peak_bin: Column, sample_rate: Column, fft_length: Column) -> Column:
    return peak_bin * (sample_rate / fft_length)


def range_velocity(
    up_hz: Column, down_hz: Column, bandwidth: Column, sweep_rate: Column, wavelength_nm: Column
) -> tuple[Column, Column]:
    """Uncalibrated range (m) and radial velocity (m/s) of an up/down beat pair."""
    distance = F.lit(SPEED_OF_LIGHT_MPS) * (up_hz + down_hz) / (F.lit(8.0) * bandwidth * sweep_rate)
    velocity = wavelength_nm * F.lit(1.0e-9) * (up_hz - down_hz) / F.lit(4.0)
    return distance, velocity


def calibrate(value: Column, scale: Column, offset: Column) -> Column:
    return value * scale + offset


def intensity(up_db: Column, down_db: Column) -> Column:
    return F.lit(0.5) * (up_db + down_db)


def setpoint_dbm(value: Column, unit: Column) -> Column:
    """Optical set-point in dBm; non-positive milliwatts are minus infinity (never in range)."""
    milliwatt = F.when(value > 0, F.lit(10.0) * F.log10(value)).otherwise(F.lit(float("-inf")))
    return F.when(unit == F.lit("dbm"), value).otherwise(milliwatt)
