"""Recordings straight to peaks: the payload is read, transformed and left in the task that reads it.

``read_recordings`` and ``measure_ascans`` hand every sample from Python to the JVM and back. Here one task reads a block,
takes both peaks of each of its records with the same kernels, and hands over the scalar columns only; contract, range, velocity
and points follow as expressions over these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from beamfold.functions.kernels import BLOCK_ROWS, _peak_struct, _peaks, _segment_matrix, window_values
from beamfold.operators.measure import PARAMETERS, with_measurement
from beamfold.operators.records import BROADCAST_ROWS, CONFIG_KEY, contract_reason, split_by_reason, with_config
from beamfold.schemas import ASCANS, PEAK_PAIR
from beamfold.sources.recordings import FORMATS, TASK_BYTES, TABLES, BLOCK_BYTES, accepted_blocks, open_file, record_columns

PEAKED = T.StructType([*(f for f in ASCANS if f.name != "samples"), T.StructField("stored", T.IntegerType()), *(T.StructField(f"{n}_peak", f.dataType) for n, f in zip(("up", "down"), PEAK_PAIR))])


def _parameters(config: DataFrame) -> dict[tuple[str | None, int], tuple]:
    """Processing parameters by (session, revision); session None holds for all sessions."""
    session = F.col("session_id") if "session_id" in config.columns else F.lit(None).cast("string")
    rows = config.select(session, F.col(CONFIG_KEY).cast("long"), *PARAMETERS).limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        raise ValueError(f"a configuration of more than {BROADCAST_ROWS} rows: measure some sessions at a time")
    return {(r[0], r[1]): tuple(r[2:]) for r in rows}


def _block_peaks(head: dict, revisions: np.ndarray, records: np.ndarray, parameters: dict) -> list[pa.StructArray]:
    """UP and DOWN peaks of a block's records (count x length). Records without parameters or with segments beyond their samples
    have none; the contract rejects them afterwards."""
    count, length = records.shape
    out = [tuple(np.full(count, v) for v in (-1, np.nan, np.nan)) for _ in range(2)]
    session, form = head["stem"].rsplit("/", 1)[-1], FORMATS[head["sample_format"]]
    for revision in np.unique(revisions).tolist():
        known = parameters.get((session, revision), parameters.get((None, revision)))
        if known is None or None in known:
            continue
        n, window, remove, invert, first, last, threshold = known
        index = np.flatnonzero(revisions == revision)
        for side, flip in (("up", False), ("down", bool(invert))):
            a, b = head[f"{side}_start"], head[f"{side}_end"]
            if not 0 <= a < b <= length:
                continue
            weights = window_values(window, b - a)
            coherent = max(float(weights.sum()), 1.0)
            weights = weights * ((-1.0 if flip else 1.0) / 32768.0)
            target = out[side == "down"]
            for at in range(0, len(index), BLOCK_ROWS):
                some = index[at:at + BLOCK_ROWS]
                rows = records[some[0]:some[-1] + 1] if some[-1] - some[0] == len(some) - 1 else records[some]
                found = _peaks(_segment_matrix(rows, form, a, b, bool(remove), weights), int(n), coherent, int(first), int(last), float(threshold))
                for values, value in zip(target, found):
                    values[some] = value
    return [_peak_struct(*side) for side in out]


def _transform(parameters: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stream = None, None
        for batch in batches:
            for head in batch.to_pylist():
                if head["path"] != path:
                    path, stream = head["path"], open_file(head["path"])
                raw = stream.read_at(int(head["header_bytes"]) + int(head["payload_bytes"]), head["offset"])
                records = np.frombuffer(raw, np.dtype(TABLES[head["stream_version"]]), count=head["record_count"],
                                        offset=0 if head["stream_version"] == 1 else BLOCK_BYTES)
                samples = np.frombuffer(raw, "<i2", offset=int(head["header_bytes"])).reshape(len(records), head["record_length"])
                columns = record_columns(head, records)
                columns["stored"] = pa.array(np.full(len(records), head["record_length"], np.int32))
                columns["up_peak"], columns["down_peak"] = _block_peaks(head, records["config_revision"].astype(np.int64), samples, parameters)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def peak_recordings(spark: SparkSession, path: str, config: DataFrame, *, formats: Sequence[str] = ("v1", "v2", "v3"),
                    sessions: DataFrame | None = None, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, DataFrame]:
    """All recordings below ``path`` as (scalar columns of A-scans with up_peak, down_peak and ``stored``, rejected parts and blocks).

    ``config`` has at most ``BROADCAST_ROWS`` rows, which go to every task; more are refused.
    """
    good, rejects = accepted_blocks(spark, path, formats=formats, sessions=sessions, task_bytes=task_bytes)
    return good.mapInArrow(_transform(_parameters(config)), PEAKED), rejects


def measure_recordings(spark: SparkSession, path: str, config: DataFrame, *, place: Callable[[DataFrame], DataFrame] | None = None,
                       formats: Sequence[str] = ("v1", "v2", "v3"), sessions: DataFrame | None = None,
                       task_bytes: int = TASK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(measurements, rejected records with a reason, rejected parts and blocks). ``place`` may set positions between peaks and points.

    The measurements are those of ``measure_ascans`` over ``read_recordings``; the two outputs of records come from one scan, so
    write the rows with their reason once where both are wanted (``reject_reason`` in the second).
    """
    rows, rejects = peak_recordings(spark, path, config, formats=formats, sessions=sessions, task_bytes=task_bytes)
    rows = with_config(place(rows) if place else rows, config)
    good, bad = split_by_reason(rows.withColumn("reject_reason", contract_reason(rows.columns, parameters=PARAMETERS)))
    return with_measurement(good.drop("stored")).drop("cfg"), bad.drop("cfg", "stored", "up_peak", "down_peak"), rejects
