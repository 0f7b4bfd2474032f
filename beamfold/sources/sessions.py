"""Session sidecars, manifests, recorded setups and stream matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beamfold.operators.configuration import nearly
from beamfold.operators.records import first_reason, split_by_reason, stored_count
from beamfold.schemas import SESSIONS, STANDARD_COORDINATE_FRAME

DATA_FORMAT_VERSION = 3


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar documents with their recording's ``stem``; broken documents come back with NULL ids."""
    documents = (
        spark.read.schema(SESSIONS).option("multiLine", "true").option("mode", "PERMISSIVE")
        .option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(path))
    # The path comes percent-encoded; a plus sign in it is one.
    path_ = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    stem = F.regexp_replace(path_, r"(\.raw)?\.json$", "")
    # File paths come with one or three slashes after the scheme; stems use the short form.
    return documents.withColumn("stem", F.regexp_replace(stem, r"^file:/+", "file:/"))


def write_manifest(ascans: DataFrame, clouds: DataFrame | None, path: str | None, *, closings: DataFrame | None = None,
                   file: str | None = None) -> DataFrame:
    """Per session: blocks, records, frames, sample bytes, first and last stamp, files, stream, how it ended.

    ``closings`` (session_id, completed, stop_reason, end_timestamp_utc_ns) is what the recorder said when it closed a session. A session
    without one was not closed: ``completed`` is false and ``stop_reason`` NULL. One with nothing but a closing has no blocks. ``file``
    names a column with each row's file, as ``_metadata.file_path`` gives it; ``data_files`` lists their names, with the partition's folders, in order.
    """
    name = F.regexp_extract(F.col(file), r"([^/=]+=[^/]*/)*[^/]+$", 0) if file else F.lit(None).cast("string")
    stream = F.struct(*(c for c in ("channel", "sample_rate_hz", "record_length", "records_in_buffer") if c in ascans.columns))
    blocks = ascans.groupBy("session_id", "dma_buffer_sequence").agg(
        F.count(F.lit(1)).alias("n"), F.sum(stored_count(ascans.columns).cast("long") * 2).alias("bytes"),
        F.min("host_timestamp_ns").alias("lo"), F.max("host_timestamp_ns").alias("hi"), F.min(name).alias("a"), F.max(name).alias("b"), F.min(stream).alias("stream"))
    manifest = blocks.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("blocks_written"), F.sum("n").cast("long").alias("records_written"),
        F.sum("bytes").cast("long").alias("bytes_written"), F.min("lo").alias("start_timestamp_ns"),
        F.max("hi").alias("end_timestamp_ns"), F.array_sort(F.array_union(F.collect_set("a"), F.collect_set("b"))).alias("data_files"),
        F.min("stream").alias("raw_stream"))
    if clouds is not None:
        frames = clouds.groupBy("session_id").agg(F.count(F.lit(1)).alias("frames_written"))
        manifest = manifest.join(frames, "session_id", "left")
    else:
        manifest = manifest.withColumn("frames_written", F.lit(0).cast("long"))
    if closings is not None:
        manifest = manifest.join(closings.select("session_id", "completed", "stop_reason", "end_timestamp_utc_ns"), "session_id", "full")
    else:
        manifest = manifest.select("*", *(F.lit(None).cast(t).alias(n) for n, t in (("completed", "boolean"), ("stop_reason", "string"), ("end_timestamp_utc_ns", "long"))))
    counts = ("blocks_written", "records_written", "bytes_written", "frames_written")
    manifest = manifest.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts} | {
        "completed": F.coalesce("completed", F.lit(False)), "data_files": F.coalesce("data_files", F.array().cast("array<string>")),
        "coordinate_frame": F.lit(STANDARD_COORDINATE_FRAME), "data_format_version": F.lit(DATA_FORMAT_VERSION)})
    if path is not None:
        manifest.write.mode("overwrite").parquet(path)
    return manifest


def resolve_recorded_setup(candidates: DataFrame, boards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pick each session's setup: the first decodable candidate by priority, on a known board.

    Candidates: session_id, source (``yaml`` or ``json``), priority, decodable, board_profile, directory,
    waveform_file. Returns the chosen setups, and a warning per candidate passed over or board rejected.
    """
    order = F.when(F.col("decodable"), F.col("priority"))
    packed = F.struct("source", "priority", "board_profile", "directory", "waveform_file")
    best = candidates.groupBy("session_id").agg(F.min_by(packed, order).alias("_b"), F.min(order).alias("_p"))
    chosen = best.where(F.col("_p").isNotNull()).select("session_id", "_b.*")
    unknown = chosen.join(boards.select(F.col("profile_id").alias("board_profile")), "board_profile", "left_anti")
    setup = chosen.join(boards.select(F.col("profile_id").alias("board_profile")), "board_profile", "left_semi")
    relative = ~F.col("waveform_file").startswith("/")
    setup = setup.withColumn("waveform_file", F.when(
        relative, F.concat_ws("/", "directory", "waveform_file")).otherwise(F.col("waveform_file")))
    passed = candidates.join(best.select("session_id", "_p"), "session_id").where(
        ~F.col("decodable") & (F.col("_p").isNull() | (F.col("priority") < F.col("_p"))))
    warnings = passed.select("session_id", "source", F.lit("not_decodable").alias("warning")).unionByName(
        unknown.select("session_id", "source", F.lit("unknown_board").alias("warning")))
    return setup, warnings


def match_reason(stream: str = "", profile: str = "cfg_") -> Column:
    def pair(name: str) -> tuple[Column, Column]:
        return F.col(f"{stream}{name}"), F.col(f"{profile}{name}")

    (channel, want_channel), (length, want_length) = pair("channel"), pair("record_length")
    (block, want_block), (rate, want_rate) = pair("records_per_buffer"), pair("sample_rate_hz")
    return first_reason([
        (F.col(f"{profile}channel").isNotNull(), "no_profile"),
        (channel == want_channel, "channel"),
        (length == want_length, "record_length"),
        ((F.col("version") == 1) | (block == want_block), "records_per_buffer"),
        (nearly(rate, want_rate), "sample_rate"),
    ])


def stream_descriptor_match(headers: DataFrame, config: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accept recordings whose stream matches the session's profile, rates within a relative 1e-9 or 1 Hz."""
    names = ("channel", "record_length", "records_per_buffer", "sample_rate_hz")
    profile = config.select("session_id", *[F.col(n).alias(f"cfg_{n}") for n in names])
    joined = headers.join(profile, "session_id", "left")
    return split_by_reason(joined.withColumn("reject_reason", match_reason()))
