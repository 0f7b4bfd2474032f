"""Arrow kernels over whole raster frames: medians over time and rows in between, for all cells of a frame at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from beamfold.functions.geometry import ANGULAR_GATE_SCALE, MINIMUM_RANGE_GATE_M, POINT_FIELDS

#: Cells worked on at once, so that a task's memory does not grow with Spark's Arrow batches; a larger frame goes by itself.
CELLS_AT_ONCE = 1 << 15
_FIELDS = [T.StructField(n, T.DoubleType()) for n in POINT_FIELDS]
#: A fused cell; source_valid: the newest frame has it, too.
FUSED_CELLS = T.ArrayType(T.StructType([*_FIELDS, T.StructField("valid", T.BooleanType()), T.StructField("source_valid", T.BooleanType()),
                                        T.StructField("temporal_observations", T.IntegerType())]))
SHOWN_CELLS = T.ArrayType(T.StructType([
    T.StructField("x_index", T.IntegerType()), T.StructField("y_index", T.IntegerType()), T.StructField("display_y", T.IntegerType()), *_FIELDS,
    *(T.StructField(n, T.BooleanType()) for n in ("valid", "source_valid")), T.StructField("temporal_observations", T.IntegerType()), T.StructField("interpolated", T.BooleanType())]))


def _numbers(cells: pa.StructArray) -> np.ndarray:
    """Fields x cells, NaN where null."""
    return np.stack([cells.field(cells.type.get_field_index(n)).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in POINT_FIELDS])


def _flag(cells: pa.StructArray, name: str) -> np.ndarray:
    return cells.field(cells.type.get_field_index(name)).fill_null(False).to_numpy(zero_copy_only=False)


def _offsets(lists: pa.ListArray) -> np.ndarray:
    return lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(ends: np.ndarray) -> Iterator[slice]:
    """Runs of rows with ``CELLS_AT_ONCE`` cells together at most. ends: the cells before each row, then all of them."""
    first = 0
    while first < len(ends) - 1:
        last = max(int(np.searchsorted(ends, ends[first] + CELLS_AT_ONCE, side="right")) - 1, first + 1)
        yield slice(first, last)
        first = last


def _structs(numbers: np.ndarray, missing: np.ndarray, **more: np.ndarray) -> tuple[list[pa.Array], list[str]]:
    arrays = [pa.array(v, mask=missing) for v in numbers] + [pa.array(v) for v in more.values()]
    return arrays, [*POINT_FIELDS, *more]


@F.arrow_udf(FUSED_CELLS)
def fuse_frames(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Frames of one geometry, newest first, to the newest one with each cell's median (mean of the middle two) over all."""
    for history in batches:
        frames, outer = history.flatten(), _offsets(history)
        for run in _runs(_offsets(frames)[outer - outer[0]] if len(frames) else np.zeros(len(history) + 1, np.int64)):
            yield _fused(history[run])


def _fused(history: pa.ListArray) -> pa.ListArray:
    frames = history.flatten()
    outer, inner = _offsets(history) - history.offsets[0].as_py(), _offsets(frames)
    cells = frames.values.slice(inner[0], inner[-1] - inner[0])
    inner = inner - inner[0]
    numbers, usable = _numbers(cells), _flag(cells, "valid")
    usable = usable & np.isfinite(numbers).all(axis=0)
    depth, size = np.diff(outer), np.diff(inner)
    width = size[outer[:-1]] if len(history) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(width)])
    fused, count, newest = np.full((len(POINT_FIELDS), ends[-1]), np.nan), np.zeros(ends[-1], np.int32), np.zeros(ends[-1], bool)
    for d, n in {*zip(depth.tolist(), width.tolist())}:
        rows = np.flatnonzero((depth == d) & (width == n))
        at = inner[outer[rows][:, None] + np.arange(d)][:, :, None] + np.arange(n)
        target = (ends[rows][:, None] + np.arange(n)).ravel()
        seen = usable[at]
        many = seen.sum(axis=1)
        count[target], newest[target] = many.ravel(), seen[:, 0].ravel()
        low, high = np.maximum(many - 1, 0) // 2, np.minimum(many // 2, d - 1)
        for k, values in enumerate(numbers):
            ranked = np.sort(np.where(seen, values[at], np.nan), axis=1)
            pick = lambda i: np.take_along_axis(ranked, i[:, None, :], axis=1)[:, 0]  # noqa: E731, B023
            fused[k, target] = (0.5 * (pick(low) + pick(high))).ravel()
    arrays, names = _structs(fused, count == 0, valid=count > 0, source_valid=newest, temporal_observations=count)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays(arrays, names=names))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether neighbours may lie on one surface; the same gate as the expression ``edge_gate``."""
    with np.errstate(all="ignore"):
        ra, rb = (np.sqrt(p[0] * p[0] + p[1] * p[1] + p[2] * p[2]) for p in (a, b))
        cosine = np.maximum(np.minimum((a[0] * b[0] + a[1] * b[1] + a[2] * b[2]) / (ra * rb), 1.0), -1.0)
        gate = np.maximum(MINIMUM_RANGE_GATE_M, ANGULAR_GATE_SCALE * np.minimum(ra, rb) * np.arccos(cosine))
        return np.isfinite(a).all(axis=0) & np.isfinite(b).all(axis=0) & (ra > 0) & (rb > 0) & (np.abs(ra - rb) <= gate)


@F.arrow_udf(SHOWN_CELLS)
def densify_frames(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Fused frames to the cells on display: all of them, and ``factor - 1`` between vertical neighbours that pass the gate.
    Rows are fused frames, their width and the factor."""
    for points, width, factor in batches:
        for run in _runs(_offsets(points)):
            yield _densified(points[run], width[run], factor[run])


def _densified(points: pa.ListArray, width: pa.Array, factor: pa.Array) -> pa.ListArray:
    offsets = _offsets(points)
    cells = points.values.slice(offsets[0], offsets[-1] - offsets[0]) if len(points) else points.values
    offsets = offsets - offsets[0]
    numbers, valid = _numbers(cells), _flag(cells, "valid")
    source = _flag(cells, "source_valid")
    seen = cells.field(cells.type.get_field_index("temporal_observations")).to_numpy(zero_copy_only=False)
    frame = np.repeat(np.arange(len(points)), np.diff(offsets))
    w = width.to_numpy(zero_copy_only=False)[frame].astype(np.int64)
    steps = int(factor[0].as_py()) if len(points) else 1
    cell = np.arange(len(frame)) - offsets[frame]
    y, x = cell // w, cell % w
    height = np.diff(offsets)[frame] // w
    scale = np.where(height > 1, steps, 1)
    upper = np.flatnonzero((y + 1 < height) & valid)
    upper = upper[valid[upper + w[upper]]]
    lower = upper + w[upper]
    passed = _joined(numbers[:, upper], numbers[:, lower])
    upper, lower = upper[passed], lower[passed]
    parts = [(np.arange(len(frame)), numbers, valid, seen, y * scale, np.zeros(len(frame), bool))]
    for step in range(1, steps):
        a, b = numbers[:, upper], numbers[:, lower]
        parts.append((upper, a + (b - a) * (step / steps), np.ones(len(upper), bool), np.minimum(seen[upper], seen[lower]), y[upper] * scale[upper] + step, np.ones(len(upper), bool)))
    owner = np.concatenate([p[0] for p in parts])
    order = np.argsort(frame[owner], kind="stable")
    owner = owner[order]
    shown = np.concatenate([p[2] for p in parts])[order]
    arrays, names = _structs(
        np.concatenate([p[1] for p in parts], axis=1)[:, order], ~shown, valid=shown, source_valid=source[owner],
        temporal_observations=np.concatenate([p[3] for p in parts])[order].astype(np.int32), interpolated=np.concatenate([p[5] for p in parts])[order])
    place = [pa.array(v.astype(np.int32)) for v in (x[owner], y[owner], np.concatenate([p[4] for p in parts])[order])]
    ends = np.concatenate([[0], np.cumsum(np.bincount(frame[owner], minlength=len(points)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([*place, *arrays], names=["x_index", "y_index", "display_y", *names]))
