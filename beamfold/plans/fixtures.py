"""Files derived from the driver's tables for the readers to ingest (test bytes, not a storage format)."""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from beamfold.plans.tables import WIDTH, ascans
from beamfold.session import new_folder
from beamfold.schemas import STANDARD_COORDINATE_FRAME
from beamfold.sources.recordings import (BLOCK_BYTES, BLOCK_FIELDS, BLOCK_MAGIC, RECORD_FIELDS, RECORD_MAGIC, STREAM_BYTES,
                                          STREAM_FIELDS, STREAM_MAGIC, TRAJECTORY_FIELDS, V1_RECORD_FIELDS)

BLOCKS_PER_PART = 5


def block_bytes(version: int, rows: pd.DataFrame) -> bytes:
    """One block (or, for version 1, its records one by one) from A-scan rows of one buffer."""
    count, length = len(rows), len(rows["samples"].iloc[0])
    fields = RECORD_FIELDS + (TRAJECTORY_FIELDS if version == 3 else [])
    records = np.zeros(count, np.dtype(V1_RECORD_FIELDS if version == 1 else fields))
    records["frame_id"], records["host_timestamp_ns"] = rows["frame_id"], rows["host_timestamp_ns"]
    records["config_revision"], records["flags"] = rows["config_revision"], rows["flags"] if "flags" in rows else 0b111
    records["trigger_sequence"], records["x_index"] = rows["frame_id"], rows["record_index_in_buffer"]
    records["y_index"] = rows["dma_buffer_sequence"] % 5
    if version == 3:
        records["trajectory_index"], records["axis"], records["direction"] = rows["frame_id"] - 1, 1, 1
        records["source"], records["calibrated"] = 1, 1
    samples = np.stack(rows["samples"].to_numpy()).astype("<i2")
    if version == 1:
        records["magic"], records["version"], records["sample_rate_hz"] = RECORD_MAGIC, 1, 1e7
        records["record_length"] = records["sample_count"] = length
        records["up_end"], records["down_start"], records["down_end"] = 32, 32, 64
        return b"".join(r.tobytes() + s.tobytes() for r, s in zip(records, samples))
    head = np.zeros(1, np.dtype(BLOCK_FIELDS))
    head["magic"], head["version"], head["payload_bytes"] = BLOCK_MAGIC, version, samples.nbytes
    head["header_bytes"] = BLOCK_BYTES + records.nbytes
    head["sequence"], head["completion_ns"] = rows["dma_buffer_sequence"].iloc[0], rows["host_timestamp_ns"].iloc[0]
    head["ownership_ns"] = head["completion_ns"]
    head["record_count"], head["record_length"], head["sample_rate_hz"] = count, length, 1e7
    head["up_end"], head["down_start"], head["down_end"], head["post_trigger"] = 32, 32, 64, 64
    return head.tobytes() + records.tobytes() + samples.tobytes()


def full_buffer(rows: pd.DataFrame) -> pd.DataFrame:
    """A recorder writes full buffers only: one of fewer rows is filled up with records whose trigger is not valid."""
    spare = rows.iloc[[-1] * (WIDTH - len(rows))].assign(flags=0, record_index_in_buffer=range(len(rows), WIDTH))
    return pd.concat([rows.assign(flags=0b111), spare], ignore_index=True)


def stream_header(version: int, record_length: int, records_per_buffer: int) -> bytes:
    head = np.zeros(1, np.dtype(STREAM_FIELDS))
    head["magic"] = next(m for m, v in STREAM_MAGIC.items() if v == version)
    head["version"], head["sample_rate_hz"] = version, 1e7
    head["record_length"], head["records_per_buffer"] = record_length, records_per_buffer
    return head.tobytes()[:STREAM_BYTES[version]]


def create(path: str, data: bytes) -> None:
    """Write a file to the file system that the path names, as any executor may."""
    uri = path if "://" in path else "file://" + (path[5:] if path.startswith("file:") else path)
    system, inner = pafs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(inner), recursive=True)
    with system.open_output_stream(inner) as out:
        out.write(data)


def write_recordings(spark: SparkSession, sf_dir: str, *, damage: bool = False, gap: bool = False, values: bool = False, alien: bool = False) -> str:
    """Raw parts of five buffers each, one task per part; versions 3, 2, 1 by session number (3 only, unless the
    recording is whole or ``alien``).

    ``damage`` spoils some block headers by sequence and cuts the last block of part 0; ``values`` spoils record tables and
    segments by sequence; ``gap`` leaves part 2 of odd sessions unwritten; ``alien`` spoils the stream header of part 3 and
    gives some sessions a sidecar of another frame, or none. Version 1 has no blocks to spoil.
    The table's last buffer may have fewer than ten records; its block is filled up (``full_buffer``).
    """
    folder = new_folder(spark, "recordings")

    def write(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        session, part = key
        number = int(session[1:])
        version = 3 if (damage or gap or values) and not alien else 3 - number % 3
        if gap and number % 2 == 1 and part == 2:
            return pd.DataFrame({"bytes": [0]})
        data = stream_header(version, 64, WIDTH)
        for sequence, block in rows.sort_values("record_index_in_buffer").groupby("dma_buffer_sequence", sort=True):
            raw = bytearray(block_bytes(version, full_buffer(block) if version > 1 else block))
            if version > 1:
                for wanted, rest, at, value, size in (
                        (damage, 3, 48, 200000, 4), (damage, 5, 16, 12, 8),  # record count, payload bytes
                        (values, 2, BLOCK_BYTES, 2**64 - 1, 8), (values, 6, 108, 3_000_000_000, 4),  # frame id, end of the UP segment
                        (values and version == 3, 1, BLOCK_BYTES + 92, 9, 1), (values and version == 3, 4, BLOCK_BYTES + 56, 2**31, 4)):  # axis, x index
                    if wanted and sequence % 7 == rest:
                        raw[at:at + size] = value.to_bytes(size, "little")
            data += bytes(raw)
        if alien and part == 3:
            data = b"NOTARAW?" + data[8:]
        if damage and part == 0:
            data = data[:-100]
        create(f"{folder}/{session}.raw.{part:04d}.bin", data)
        if part == 0 and not (alien and number % 4 == 2):
            frame = "camera" if alien and number % 4 == 1 else STANDARD_COORDINATE_FRAME
            create(f"{folder}/{session}.raw.json", json.dumps({"session_id": session, "coordinate_frame": frame}).encode())
        return pd.DataFrame({"bytes": [len(data)]})

    columns = ["session_id", "frame_id", "dma_buffer_sequence", "record_index_in_buffer", "host_timestamp_ns",
               "config_revision", "samples"]
    part = F.floor(F.col("dma_buffer_sequence") / BLOCKS_PER_PART).cast("int").alias("part")
    rows = ascans(spark, sf_dir).select(*columns, part)
    rows.groupBy("session_id", "part").applyInPandas(write, "bytes long").agg(F.sum("bytes")).first()
    return folder


def write_documents(df: DataFrame, folder: str, name: str, text: str) -> None:
    """One small file per row, written by the row's task."""
    def write(batches):
        for batch in batches:
            for file, content in zip(batch[name], batch[text]):
                create(f"{folder}/{file}", content.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    df.select(name, text).mapInPandas(write, "n long").agg(F.sum("n")).first()
