"""Distributed ingest of multi-part raw recordings, and the Parquet store of A-scans.

A part is a stream header followed by blocks of one constant size, so block offsets are
arithmetic: no task walks a file to find its work. Stage 1 lists files and reads one small
header per part; stage 2 spreads fixed-size block ranges over the cluster, reads block headers
and record tables (a hundredth of the bytes) and quarantines bad blocks with native expressions;
stage 3, in the same tasks, decodes the payload of good blocks with numpy into Arrow batches.
Whatever is not decoded is listed with its reason, without a payload being read for it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from beamfold.functions.kernels import pack_samples, unpack_samples
from beamfold.operators.records import first_reason, split_by_reason
from beamfold.session import stage
from beamfold.schemas import ASCANS, FULL_CHIRP_PERIOD, PACKED_ASCANS, OFFSET_BINARY_12, SIGNED_INT16, STANDARD_COORDINATE_FRAME

# Fixed values of the raw container (all little-endian).
STREAM_MAGIC = {b"FMCWRAW1": 1, b"FMCWRAW2": 2, b"FMCWRAW3": 3}
RECORD_MAGIC = 0x314D5246
BLOCK_MAGIC = 0x32424D46
CHANNELS = ("a", "b")
FORMATS = (SIGNED_INT16, OFFSET_BINARY_12)
FRAME_KINDS = {0: FULL_CHIRP_PERIOD}
AXES = ("unknown", "x", "y")
DIRECTIONS = ("unknown", "increasing", "decreasing")
SOURCES = ("generated_raster", "mcu_trajectory", "replay")
MAXIMUM_RECORDS = 100000
MAXIMUM_RECORD_SAMPLES = 64 * 1024 * 1024
MAXIMUM_PAYLOAD_BYTES = 2**28
MAXIMUM_HEADER_BYTES = 64 * 1024 * 1024
STREAM_FIELDS = [
    ("magic", "S8"), ("version", "<u4"), ("channel", "<u4"), ("sample_format", "<u4"), ("byte_order", "<u4"),
    ("sample_rate_hz", "<f8"), ("record_length", "<u4"), ("records_per_buffer", "<u4"),
]
BLOCK_FIELDS = [
    ("magic", "<u4"), ("version", "<u4"), ("header_bytes", "<u4"), ("reserved", "<u4"), ("payload_bytes", "<u8"),
    ("sequence", "<u8"), ("completion_ns", "<u8"), ("ownership_ns", "<u8"), ("record_count", "<u4"),
    ("record_length", "<u4"), ("dropped_buffer_count", "<u8"), ("missed_trigger_count", "<u8"),
    ("frame_kind", "<u4"), ("channel", "<u4"), ("sample_format", "<u4"), ("byte_order", "<u4"),
    ("sample_rate_hz", "<f8"), ("pre_trigger", "<u4"), ("post_trigger", "<u4"), ("up_start", "<u4"),
    ("up_end", "<u4"), ("down_start", "<u4"), ("down_end", "<u4"),
]
RECORD_FIELDS = [
    ("frame_id", "<u8"), ("host_timestamp_ns", "<u8"), ("config_revision", "<u8"), ("trigger_sequence", "<u8"),
    ("trigger_ns", "<u8"), ("jitter_ns", "<i8"), ("missed", "<u4"), ("flags", "<u4"), ("x_index", "<u4"),
    ("y_index", "<u4"), ("x_angle", "<f4"), ("y_angle", "<f4"), ("optical_revision", "<u8"),
]
TRAJECTORY_FIELDS = [
    ("trajectory_index", "<u4"), ("x_command", "<f4"), ("y_command", "<f4"), ("axis", "u1"), ("direction", "u1"),
    ("source", "u1"), ("calibrated", "u1"),
]
V1_RECORD_FIELDS = [
    ("magic", "<u4"), ("version", "<u4"), ("frame_kind", "<u4"), *RECORD_FIELDS, ("channel", "<u4"),
    ("sample_format", "<u4"), ("byte_order", "<u4"), ("sample_rate_hz", "<f8"), ("record_length", "<u4"),
    ("pre_trigger", "<u4"), ("post_trigger", "<u4"), ("up_start", "<u4"), ("up_end", "<u4"), ("down_start", "<u4"),
    ("down_end", "<u4"), ("sample_count", "<u4"),
]
STREAM_BYTES = {1: 36, 2: 40, 3: 40}
BLOCK_BYTES = 120
RECORD_BYTES = {1: 144, 2: 80, 3: 96}
# Bytes of recording one task reads.
TASK_BYTES = 64 * 1024 * 1024
DESCRIPTOR = ("version", "channel", "sample_format", "byte_order", "sample_rate_hz", "record_length",
              "records_per_buffer")

HEADER_SCHEMA = (
    "path string, length long, magic_version int, version long, channel long, sample_format long, byte_order long, "
    "sample_rate_hz double, record_length long, records_per_buffer long"
)
BLOCK_SCHEMA = (
    "path string, stem string, part int, stream_version int, block long, offset long, available_bytes long, "
    "stream_channel long, stream_sample_format long, stream_sample_rate_hz double, stream_record_length long, "
    "stream_records_per_buffer long, "
    + ", ".join(f"{n} {'double' if t == '<f8' else 'decimal(20,0)' if t == '<u8' else 'long'}" for n, t in BLOCK_FIELDS)
    + ", record_fault string"
)
REJECT_COLUMNS = ("path", "stem", "part", "block", "reject_reason")
TABLES = {1: V1_RECORD_FIELDS, 2: RECORD_FIELDS, 3: RECORD_FIELDS + TRAJECTORY_FIELDS}


def open_file(path: str):
    if path.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    if "://" in path:
        # Spark's names of the S3 store are unknown to Arrow.
        system, inner = pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))
        return system.open_input_file(inner)
    return pafs.LocalFileSystem().open_input_file(path)


def list_parts(spark: SparkSession, path: str) -> DataFrame:
    """Path, length, stem and part number of every raw part below ``path`` (listing only, no content)."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").option("recursiveFileLookup", "true")
        .load(path).select("path", "length"))
    pattern = r"^(.*)\.raw\.(\d{4})\.bin$"
    numbered = F.col("path").rlike(pattern)
    return files.select(
        "path", "length",
        F.when(numbered, F.regexp_extract("path", pattern, 1)).otherwise(F.col("path")).alias("stem"),
        F.when(numbered, F.regexp_extract("path", pattern, 2).cast("int")).otherwise(F.lit(0)).alias("part"))


def read_stream_headers(files: DataFrame) -> DataFrame:
    """Add each part's stream header fields; unreadable ones have a NULL ``magic_version``."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = np.dtype(STREAM_FIELDS)
        for batch in batches:
            rows = []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                with open_file(path) as stream:
                    head = stream.read_at(dtype.itemsize, 0)
                row = np.frombuffer(head.ljust(dtype.itemsize, b"\0"), dtype)[0]
                known = STREAM_MAGIC.get(bytes(row["magic"]))
                per_buffer = 1 if known == 1 else int(row["records_per_buffer"])
                rows.append((path, length, known, *(int(row[n]) for n in DESCRIPTOR[:4]),
                             float(row["sample_rate_hz"]), int(row["record_length"]), per_buffer))
            columns = list(zip(*rows)) if rows else [[]] * 10
            types = [pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.float64(), pa.int64(), pa.int64()]
            names = ["path", "length", "magic_version", *DESCRIPTOR]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=names)

    heads = files.select("path", "length").mapInArrow(read, HEADER_SCHEMA)
    return files.join(heads.drop("length"), "path")


def stream_reason() -> Column:
    batch = F.col("magic_version") > 1
    return first_reason([
        (F.col("magic_version").isNotNull(), "stream_magic"),
        (F.col("version") == F.col("magic_version"), "stream_version"),
        (F.col("sample_format") < len(FORMATS), "sample_format"),
        (F.col("byte_order") == 0, "byte_order"),
        (F.col("record_length").between(1, MAXIMUM_RECORD_SAMPLES), "record_length"),
        (~batch | F.col("records_per_buffer").between(1, MAXIMUM_RECORDS), "records_per_buffer"),
    ])


def record_fault(records: np.ndarray) -> str | None:
    """What keeps a block's record table from being a table of A-scans: a value that no row can hold, or an unknown code."""
    for name in ("frame_id", "host_timestamp_ns", "config_revision", "trigger_sequence", "trigger_ns", "optical_revision"):
        if (records[name] >> np.uint64(63)).any():
            return "record_unsigned_range"
    if max(records["x_index"].max(), records["y_index"].max()) >= 1 << 31:
        return "record_index_range"
    if "axis" in records.dtype.names:
        known = (("axis", len(AXES)), ("direction", len(DIRECTIONS)), ("source", len(SOURCES)), ("calibrated", 2))
        if any((records[name] >= n).any() for name, n in known):
            return "trajectory"
    return None


def discover_parts(headers: DataFrame) -> DataFrame:
    """Add ``contiguous``: the part follows its stem's first part without a gap or a header change.

    A stem's rows are its file list, one short row per multi-gigabyte part.
    """
    order = Window.partitionBy("stem").orderBy("part")
    described = F.struct(*DESCRIPTOR)
    step = headers.withColumn("_gap", F.coalesce(F.col("part") - F.lag("part").over(order) != 1, F.lit(False)))
    step = step.withColumn(
        "_break", F.col("_gap") | ~F.coalesce(described == F.lag(described).over(order), F.lit(True)))
    broken = F.sum(F.col("_break").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return step.withColumn("contiguous", broken == 0).drop("_gap", "_break")


def coordinate_gate(headers: DataFrame, sessions: DataFrame, *,
                    frame: str = STANDARD_COORDINATE_FRAME) -> tuple[DataFrame, DataFrame]:
    """Legacy versions pass only when their sidecar (joined by ``stem``) declares the standard frame."""
    declared = sessions.select("stem", F.col("coordinate_frame").alias("_frame"))
    joined = headers.join(declared, "stem", "left")
    ok = (F.col("version") == 3) | (F.col("_frame") == frame)
    missing = (F.col("version") < 3) & F.col("_frame").isNull()
    reason = F.when(missing, F.lit("no_coordinate_frame")).when(~F.coalesce(ok, F.lit(False)), F.lit("coordinate_frame"))
    return split_by_reason(joined.withColumn("reject_reason", reason).drop("_frame"))


def block_stride() -> Column:
    """Bytes per block of a part (per record for version 1)."""
    payload = F.col("record_length") * 2
    table = F.when(F.col("version") == 2, F.lit(RECORD_BYTES[2])).otherwise(F.lit(RECORD_BYTES[3]))
    batch = F.lit(BLOCK_BYTES) + F.col("records_per_buffer") * (table + payload)
    return F.when(F.col("version") == 1, F.lit(RECORD_BYTES[1]) + payload).otherwise(batch)


def block_ranges(headers: DataFrame, *, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Ranges of whole blocks, about ``task_bytes`` each, dealt evenly to as many partitions.

    A trailing remainder counts as one more (truncated) block, so it is reported, not lost.
    """
    start = F.when(F.col("version") == 1, F.lit(STREAM_BYTES[1])).otherwise(F.lit(STREAM_BYTES[3]))
    sized = headers.withColumn("stride", block_stride()).withColumn("first_offset", start)
    blocks = F.ceil((F.col("length") - F.col("first_offset")) / F.col("stride")).cast("long")
    # Version 1 has no block numbers: its records are numbered over all parts of the recording.
    earlier = Window.partitionBy("stem").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("blocks", blocks).withColumn("base_block", F.coalesce(F.sum("blocks").over(earlier), F.lit(0))).where("blocks > 0")
    sized = sized.withColumn("per_task", F.greatest(F.lit(1), F.floor(F.lit(task_bytes) / F.col("stride")).cast("long")))
    ranges = sized.withColumn(
        "first_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1, F.col("per_task"))))
    ranges = ranges.withColumn("block_count", F.least(F.col("per_task"), F.col("blocks") - F.col("first_block")))
    # Ranges are tiny rows standing for large reads, so AQE must not merge them by row size.
    tasks = sized.agg(F.sum(F.ceil(F.col("blocks") / F.col("per_task")))).first()[0] or 1
    return ranges.repartition(int(max(tasks, 1)))


def scan_blocks(headers: DataFrame, *, task_bytes: int = TASK_BYTES) -> DataFrame:
    """One row per block with its header fields and the verdict on its record table; no payload is read."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v1, v23 = np.dtype(V1_RECORD_FIELDS), np.dtype(BLOCK_FIELDS)
        for batch in batches:
            for row in batch.to_pylist():
                dtype = v1 if row["version"] == 1 else v23
                table = np.dtype(TABLES[row["version"]])
                size = dtype.itemsize + (0 if row["version"] == 1 else row["records_per_buffer"] * table.itemsize)
                offsets = [
                    row["first_offset"] + (row["first_block"] + i) * row["stride"] for i in range(row["block_count"])]
                raw, faults = [], []
                with open_file(row["path"]) as stream:
                    for offset in offsets:
                        data = stream.read_at(size, offset)
                        raw.append(data[:dtype.itemsize].ljust(dtype.itemsize, b"\0"))
                        # A shorter block has a reason of its own.
                        whole = len(data) == size
                        records = np.frombuffer(data, table, offset=0 if row["version"] == 1 else BLOCK_BYTES) if whole else None
                        faults.append(record_fault(records) if whole else None)
                heads = np.frombuffer(b"".join(raw), dtype)
                count = len(heads)
                if row["version"] == 1:
                    block = np.zeros(count, v23)
                    for name in ("magic", "version", "record_length", "frame_kind", "channel", "sample_format",
                                 "byte_order", "sample_rate_hz", "pre_trigger", "post_trigger", "up_start", "up_end",
                                 "down_start", "down_end"):
                        block[name] = heads[name]
                    block["version"], block["record_count"] = 1, 1
                    block["header_bytes"] = RECORD_BYTES[1]
                    block["payload_bytes"] = heads["sample_count"].astype(np.int64) * 2
                    block["sequence"] = row["base_block"] + row["first_block"] + np.arange(count)
                    block["completion_ns"] = block["ownership_ns"] = heads["host_timestamp_ns"]
                    heads = block

                def same(value, kind):
                    return pa.array([value] * count, kind)

                columns = [
                    same(row["path"], pa.string()), same(row["stem"], pa.string()), same(row["part"], pa.int32()),
                    same(row["version"], pa.int32()), pa.array(row["first_block"] + np.arange(count)),
                    pa.array(np.array(offsets, np.int64)),
                    pa.array(row["length"] - np.array(offsets, np.int64)),
                    *[same(row[n], pa.int64()) for n in ("channel", "sample_format")],
                    same(row["sample_rate_hz"], pa.float64()),
                    *[same(row[n], pa.int64()) for n in ("record_length", "records_per_buffer")],
                ]
                for name, kind in BLOCK_FIELDS:
                    if kind == "<f8":
                        columns.append(pa.array(heads[name].astype(np.float64)))
                    elif kind == "<u8":
                        columns.append(pa.array(heads[name].astype(np.uint64)).cast(pa.decimal128(20, 0)))
                    else:
                        columns.append(pa.array(heads[name].astype(np.int64)))
                columns.append(pa.array(faults, pa.string()))
                names = [field.split(" ")[0] for field in BLOCK_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    needed = ["path", "stem", "part", "length", "version", "channel", "sample_format", "sample_rate_hz",
              "record_length", "records_per_buffer", "stride", "first_offset", "base_block", "first_block", "block_count"]
    ranges = block_ranges(headers, task_bytes=task_bytes).select(
        *[F.col(c).cast("int") if c == "version" else F.col(c) for c in needed])
    return ranges.mapInArrow(read, BLOCK_SCHEMA)


def quarantine_blocks(blocks: DataFrame, *, max_records: int = MAXIMUM_RECORDS,
                      max_payload_bytes: int = MAXIMUM_PAYLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Split blocks into good ones and rejects with a reason. Values that the reader of single records would take but no row can
    hold (whole numbers of 63 bits and more, segment bounds and indices of 31) are reasons, too."""
    c = F.col
    v1 = c("stream_version") == 1
    magic = F.when(v1, F.lit(RECORD_MAGIC)).otherwise(F.lit(BLOCK_MAGIC))
    table = F.when(c("stream_version") == 2, F.lit(RECORD_BYTES[2])).otherwise(F.lit(RECORD_BYTES[3]))
    header = F.when(v1, F.lit(RECORD_BYTES[1])).otherwise(F.lit(BLOCK_BYTES) + c("record_count") * table)
    in_range = F.lit(True)
    for name in ("sequence", "completion_ns", "ownership_ns", "dropped_buffer_count", "missed_trigger_count"):
        in_range = in_range & (c(name) <= F.lit(2**63 - 1).cast("decimal(20,0)"))
    reason = first_reason([
        (c("available_bytes") >= F.when(v1, F.lit(RECORD_BYTES[1])).otherwise(F.lit(BLOCK_BYTES)), "truncated_header"),
        (c("magic") == magic, "block_magic"),
        (c("version") == c("stream_version"), "block_version"),
        ((c("record_count") > 0) & (c("record_count") <= max_records), "record_count"),
        (v1 | (c("record_count") == c("stream_records_per_buffer")), "records_per_buffer"),
        ((c("record_length") > 0) & (c("record_length") == c("stream_record_length")), "record_length"),
        ((c("channel") == c("stream_channel")) & (c("sample_format") == c("stream_sample_format"))
         & (c("byte_order") == 0) & (c("sample_rate_hz") == c("stream_sample_rate_hz")), "stream_mismatch"),
        (c("payload_bytes") == c("record_count") * c("record_length") * 2, "payload_bytes"),
        (c("payload_bytes") <= max_payload_bytes, "payload_limit"),
        ((c("header_bytes") == header) & (header <= MAXIMUM_HEADER_BYTES), "header_bytes"),
        (c("header_bytes") + c("payload_bytes") <= c("available_bytes"), "truncated_payload"),
        (in_range, "unsigned_range"),
        (F.greatest("up_start", "up_end", "down_start", "down_end") < 2**31, "segment_range"),
    ])
    return split_by_reason(blocks.withColumn("reject_reason", F.coalesce(reason, c("record_fault"))))


def _names(codes: np.ndarray, spellings: Sequence[str]) -> pa.Array:
    codes = np.where(codes < len(spellings), codes, 0).astype(np.int8)
    return pa.DictionaryArray.from_arrays(pa.array(codes), pa.array(spellings)).cast(pa.string())


def record_columns(head: dict, records: np.ndarray) -> dict[str, pa.Array]:
    """Columns of one block's A-scans without their samples."""
    count, length = len(records), head["record_length"]
    trajectory = "axis" in records.dtype.names

    def same(value, kind):
        return pa.array([value] * count, kind)

    def wide(name):
        return pa.array(records[name].astype(np.int64))

    def flag(bit):
        return pa.array((records["flags"] >> bit) & 1 == 1)

    def struct(**fields):
        return pa.StructArray.from_arrays(list(fields.values()), names=list(fields))

    def optional(name, kind):
        return pa.array(records[name].astype(kind)) if trajectory else pa.nulls(count, pa.from_numpy_dtype(kind))

    position = struct(
        x_index=pa.array(records["x_index"].astype(np.int32)), y_index=pa.array(records["y_index"].astype(np.int32)),
        trajectory_sample_index=optional("trajectory_index", np.int64),
        x_command=optional("x_command", np.float64), y_command=optional("y_command", np.float64),
        x_angle_deg=pa.array(records["x_angle"].astype(np.float64)),
        y_angle_deg=pa.array(records["y_angle"].astype(np.float64)),
        fast_axis=_names(records["axis"], AXES) if trajectory else same("unknown", pa.string()),
        direction=_names(records["direction"], DIRECTIONS) if trajectory else same("unknown", pa.string()),
        source=_names(records["source"], SOURCES) if trajectory else same("replay", pa.string()),
        angle_calibrated=pa.array(records["calibrated"] == 1) if trajectory else flag(1),
        valid=flag(1))
    segment = {
        side: struct(start=same(head[f"{side}_start"], pa.int32()), end_excl=same(head[f"{side}_end"], pa.int32()))
        for side in ("up", "down")
    }
    v1 = head["stream_version"] == 1
    return {
        "session_id": same(head["stem"].rsplit("/", 1)[-1], pa.string()),
        "frame_id": wide("frame_id"),
        "dma_buffer_sequence": same(int(head["sequence"]), pa.int64()),
        "record_index_in_buffer": pa.array(np.arange(count, dtype=np.int32)),
        "records_in_buffer": same(1 if v1 else count, pa.int32()),
        "host_timestamp_ns": wide("host_timestamp_ns"),
        "config_revision": wide("config_revision"),
        "trigger": struct(sequence=wide("trigger_sequence"), timestamp_ns=wide("trigger_ns"),
                          period_jitter_ns=wide("jitter_ns"), missed_trigger_count=wide("missed"), valid=flag(0)),
        "pos": position,
        "optical": struct(revision=wide("optical_revision"), laser_enabled=flag(2), edfa_used=flag(3),
                          edfa_output_enabled=flag(4)),
        "channel": same(CHANNELS[head["channel"]] if head["channel"] < len(CHANNELS) else None, pa.string()),
        "sample_format": same(FORMATS[head["sample_format"]], pa.string()),
        "frame_kind": pa.array([FRAME_KINDS.get(int(k)) for k in records["frame_kind"]], pa.string()) if v1 else same(FRAME_KINDS.get(head["frame_kind"]), pa.string()),
        "sample_rate_hz": same(head["sample_rate_hz"], pa.float64()),
        "record_length": same(length, pa.int32()),
        "pre_trigger_samples": same(head["pre_trigger"], pa.int64()),
        "post_trigger_samples": same(head["post_trigger"], pa.int64()),
        "up_segment": segment["up"],
        "down_segment": segment["down"],
    }


def _record_batch(head: dict, records: np.ndarray, samples: np.ndarray, packed: bool) -> pa.RecordBatch:
    """Arrow rows of one block, in the ``ASCANS`` or ``PACKED_ASCANS`` layout."""
    count, length, columns = len(records), head["record_length"], record_columns(head, records)
    ends = np.arange(count + 1, dtype=np.int32) * length
    if packed:
        columns["payload"] = pa.BinaryArray.from_buffers(
            pa.binary(), count, [None, pa.py_buffer(ends * 2), pa.py_buffer(samples)])
    else:
        columns["samples"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(samples))
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def decode_blocks(good: DataFrame, *, packed: bool = False) -> DataFrame:
    """A-scan rows of good blocks; one seek and one read per block, the payload never unpacked if ``packed``."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, stream = None, None
            for head in batch.to_pylist():
                if head["path"] != path:
                    path, stream = head["path"], open_file(head["path"])
                size = int(head["header_bytes"]) + int(head["payload_bytes"])
                raw = stream.read_at(size, head["offset"])
                fixed = 0 if head["stream_version"] == 1 else BLOCK_BYTES
                records = np.frombuffer(
                    raw, np.dtype(TABLES[head["stream_version"]]), count=head["record_count"], offset=fixed)
                samples = np.frombuffer(raw, "<i2", offset=int(head["header_bytes"]))
                yield _record_batch(head, records, samples, packed)

    return good.mapInArrow(decode, PACKED_ASCANS if packed else ASCANS)


def accepted_blocks(spark: SparkSession, path: str, *, formats: Sequence[str] = ("v1", "v2", "v3"), sessions: DataFrame | None = None,
                    task_bytes: int = TASK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(headers of the blocks to read, rejects) of all recordings below ``path``.

    ``rejects`` lists what is left out, as path, stem, part, block (NULL: the whole part) and reject_reason: unreadable stream
    headers, parts behind a gap or a change of header (``not_contiguous``), legacy parts whose sidecar in ``sessions`` does
    not declare the standard frame, and quarantined blocks. Versions outside ``formats`` are not asked for and not listed.
    """
    wanted = [int(f[1:]) for f in formats]
    headers = read_stream_headers(list_parts(spark, path))
    headers, unreadable = split_by_reason(headers.withColumn("reject_reason", stream_reason()))
    parts = discover_parts(headers.where(F.col("version").isin(wanted)))
    apart = parts.where("not contiguous").withColumn("reject_reason", F.lit("not_contiguous"))
    if sessions is None:
        sessions = spark.createDataFrame([], "stem string, coordinate_frame string")
    accepted, alien = coordinate_gate(parts.where("contiguous"), sessions)
    # One row per part, written once: blocks, rejects and the number of tasks all start from it.
    judged = accepted.withColumn("reject_reason", F.lit(None).cast("string"))
    for whole in (apart, alien, unreadable.withColumn("contiguous", F.lit(None).cast("boolean"))):
        judged = judged.unionByName(whole)
    accepted, refused = split_by_reason(stage(judged, "parts"))
    good, bad = quarantine_blocks(scan_blocks(accepted, task_bytes=task_bytes))
    refused = refused.withColumn("block", F.lit(None).cast("long"))
    return good, bad.select(*REJECT_COLUMNS).unionByName(refused.select(*REJECT_COLUMNS))


def read_recordings(spark: SparkSession, path: str, *, formats: Sequence[str] = ("v1", "v2", "v3"),
                    sessions: DataFrame | None = None, packed: bool = False,
                    task_bytes: int = TASK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All recordings below ``path`` as (ascans, batches, rejects); see ``accepted_blocks`` for what is rejected."""
    good, rejects = accepted_blocks(spark, path, formats=formats, sessions=sessions, task_bytes=task_bytes)
    long_fields = ("sequence", "completion_ns", "ownership_ns", "dropped_buffer_count", "missed_trigger_count")
    batches = good.select(
        F.element_at(F.split("stem", "/"), -1).alias("session_id"), "part", "block",
        *[F.col(c).cast("long").alias(c) for c in long_fields], "record_count", "record_length")
    return decode_blocks(good, packed=packed), batches, rejects


def write_ascans(ascans: DataFrame, path: str, *, split_gb: float = 4.0) -> None:
    """Parquet by session and part, ordered by buffer; a part holds whole buffers of about ``split_gb``.

    The part is arithmetic on the buffer number, so one hash shuffle places every part in one
    task, a session of any size spreads over its parts, and no pass counts or samples the payload.
    """
    packed = ascans if "payload" in ascans.columns else ascans.withColumn(
        "payload", pack_samples(F.col("samples"))).drop("samples")
    buffer_bytes = F.col("records_in_buffer").cast("double") * (F.col("record_length") * 2 + RECORD_BYTES[3])
    buffers_per_part = F.greatest(F.floor(F.lit(split_gb * 1e9) / buffer_bytes), F.lit(1))
    packed = packed.withColumn("part", F.floor(F.col("dma_buffer_sequence") / buffers_per_part).cast("long"))
    (
        packed.repartition("session_id", "part")
        .sortWithinPartitions("session_id", "part", "dma_buffer_sequence", "record_index_in_buffer")
        .write.partitionBy("session_id", "part").parquet(path)
    )


def read_by_session(spark: SparkSession, path: str) -> DataFrame:
    """A table partitioned by session, its ids as written: ``007`` is not the number 7."""
    schema = spark.read.parquet(path).schema
    schema["session_id"].dataType = T.StringType()
    return spark.read.schema(schema).parquet(path)


def read_ascans(spark: SparkSession, path: str, *, unpack: bool = False) -> DataFrame:
    """Stored A-scans, as packed rows (the form to measure) or with ``samples`` arrays."""
    rows = read_by_session(spark, path).drop("part")
    return rows.withColumn("samples", unpack_samples(F.col("payload"))).drop("payload") if unpack else rows
