"""Angles, Cartesian conversion and the range-jump gate."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

POINT_FIELDS = ("x", "y", "z", "intensity", "velocity", "scan_x", "scan_y")
# Range-jump gate of the vertical densifier.
MINIMUM_RANGE_GATE_M = 0.05
ANGULAR_GATE_SCALE = 3.0


def is_finite(value: Column) -> Column:
    """False for NULL, NaN and the infinities."""
    number = value.cast("double")
    return F.coalesce(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), F.lit(False))


def finite_or_null(value: Column) -> Column:
    return F.when(is_finite(value), value)


def index_to_angle(index: Column, count: Column, low: Column, high: Column) -> Column:
    angle = low + (high - low) * (index.cast("double") / (count - 1).cast("double"))
    usable = (count >= 2) & (index >= 0) & (index < count) & is_finite(low) & is_finite(high)
    return F.when(usable, angle)


def line_to_elevation(line: Column, count: Column, low: Column, high: Column) -> Column:
    """Lines arrive from the top of the scan, so line 0 carries the highest angle."""
    return index_to_angle(line, count, high, low)


def to_xyz(range_m: Column, velocity: Column, intensity_db: Column, pos: Column, calib: Column) -> Column:
    """Calibrated spherical measurement to a Cartesian point (+X forward, +Y left, +Z up).

    ``pos`` carries angles and commands, ``calib`` the two angle offsets. Every field is NULL
    and ``valid`` false when the position or any input is unusable.
    """
    x_angle, y_angle = pos.getField("x_angle_deg"), pos.getField("y_angle_deg")
    x_offset, y_offset = calib.getField("x_angle_offset_deg"), calib.getField("y_angle_offset_deg")
    usable = F.coalesce(pos.getField("valid"), F.lit(False))
    for value in (range_m, velocity, intensity_db, x_angle, y_angle, x_offset, y_offset):
        usable = usable & is_finite(value)
    azimuth, elevation = F.radians(x_angle + x_offset), F.radians(y_angle + y_offset)
    horizontal = range_m * F.cos(elevation)
    fields = {
        "x": horizontal * F.cos(azimuth),
        "y": horizontal * F.sin(azimuth),
        "z": range_m * F.sin(elevation),
        "intensity": intensity_db,
        "velocity": velocity,
        "scan_x": pos.getField("x_command"),
        "scan_y": pos.getField("y_command"),
    }
    return F.struct(
        *[F.when(usable, value.cast("double")).alias(name) for name, value in fields.items()],
        usable.alias("valid"),
    )


def finite_point(point: Column) -> Column:
    ok = F.coalesce(point.getField("valid"), F.lit(False))
    for name in POINT_FIELDS:
        ok = ok & is_finite(point.getField(name))
    return ok


def point_range(point: Column) -> Column:
    x, y, z = (point.getField(name) for name in ("x", "y", "z"))
    return F.sqrt(x * x + y * y + z * z)


def edge_gate(a: Column, b: Column) -> Column:
    """Whether two neighbours may lie on one surface: their range step stays within a few angular steps."""
    range_a, range_b = point_range(a), point_range(b)
    product = sum((a.getField(n) * b.getField(n) for n in ("y", "z")), a.getField("x") * b.getField("x"))
    cosine = F.greatest(F.least(product / (range_a * range_b), F.lit(1.0)), F.lit(-1.0))
    gate = F.greatest(
        F.lit(MINIMUM_RANGE_GATE_M), F.lit(ANGULAR_GATE_SCALE) * F.least(range_a, range_b) * F.acos(cosine)
    )
    positive = finite_point(a) & finite_point(b) & (range_a > 0) & (range_b > 0)
    return F.coalesce(positive & (F.abs(range_a - range_b) <= gate), F.lit(False))
