"""Record and batch contracts, segments, windows, record selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beamfold.functions.kernels import unpack_samples
from beamfold.functions.samples import decode_samples, normalize_samples, slice_segment, valid_segment
from beamfold.functions.signal import window_weight
from beamfold.schemas import FULL_CHIRP_PERIOD

CONFIG_KEY = "config_revision"
BATCH_KEYS = ["session_id", "dma_buffer_sequence"]
# A configuration row has a few hundred bytes, so this bounds what is broadcast to a few megabytes.
BROADCAST_ROWS = 10_000


def first_reason(rules: list[tuple[Column, str]]) -> Column:
    """The name of the first failing rule, NULL when all hold. A rule is (must be true, name)."""
    reasons = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules]
    return F.coalesce(*reasons, F.lit(None).cast("string"))


def split_by_reason(tagged: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    return tagged.where(F.col(reason).isNull()).drop(reason), tagged.where(F.col(reason).isNotNull())


def with_config(df: DataFrame, config: DataFrame, *, key: str = CONFIG_KEY, alias: str = "cfg") -> DataFrame:
    """Attach the row's configuration as one struct column.

    A configuration with a ``session_id`` belongs to that session's revision, as revisions count per session; one without
    holds for all sessions. It is a few short rows; up to ``BROADCAST_ROWS`` of them, counted first, it is sent to the
    rows, so that samples stay where they are. A larger one is joined by key.
    """
    keys = [k for k in ("session_id", key) if k in config.columns and k in df.columns]
    fields = [c for c in config.columns if c not in keys]
    side = config.select(*keys, F.struct(*fields).alias(alias))
    if config.select(*keys).limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return df.join(side, keys, "left")


def stored_count(columns: list[str]) -> Column:
    """Stored samples per record, for array rows, packed payload rows and rows that left their samples behind."""
    if "stored" in columns:
        return F.col("stored")
    return (F.length("payload") / 2).cast("int") if "payload" in columns else F.size("samples")


def contract_reason(columns: list[str], cfg: str = "cfg", parameters: tuple[str, ...] = ()) -> Column:
    """The first rule of the record contract that a row breaks. parameters: configuration values that must be there."""
    up, down = F.col("up_segment"), F.col("down_segment")
    length = F.col(f"{cfg}.sample_point")

    def same(segment: Column, side: str) -> Column:
        return (segment.getField("start") == F.col(f"{cfg}.{side}_start")) & (
            segment.getField("end_excl") == F.col(f"{cfg}.{side}_end"))

    return first_reason([
        (F.col(cfg).isNotNull(), "no_config"),
        *([(F.col("frame_kind") == FULL_CHIRP_PERIOD, "frame_kind")] if "frame_kind" in columns else []),
        (F.col("channel") == F.col(f"{cfg}.channel"), "channel"),
        ((stored_count(columns) == length) & (F.col("record_length") == length), "sample_count"),
        (valid_segment(up, length), "up_segment"),
        (valid_segment(down, length), "down_segment"),
        (same(up, "up") & same(down, "down"), "segment_config"),
        *[(F.col(f"{cfg}.{p}").isNotNull(), "incomplete_config") for p in parameters],
    ])


def check_record_contract(ascans: DataFrame, config: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split records into those that honour their configuration and rejects with a reason."""
    tagged = with_config(ascans, config).withColumn("reject_reason", contract_reason(ascans.columns)).drop("cfg")
    return split_by_reason(tagged)


def batch_faults(ascans: DataFrame) -> DataFrame:
    """One row per inconsistent buffer: wrong count, or indices that are not exactly 0..n-1."""
    stats = ascans.groupBy(*BATCH_KEYS).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("records_in_buffer").alias("low"),
        F.max("records_in_buffer").alias("high"),
        F.min("record_index_in_buffer").alias("first"),
        F.max("record_index_in_buffer").alias("last"),
        F.count_distinct("record_index_in_buffer").alias("distinct"),
    )
    reason = first_reason([
        (F.col("low") == F.col("high"), "records_in_buffer"),
        (F.col("n") == F.col("high"), "record_count"),
        ((F.col("first") == 0) & (F.col("last") == F.col("n") - 1) & (F.col("distinct") == F.col("n")),
         "record_index"),
    ])
    return stats.select(*BATCH_KEYS, reason.alias("reject_reason")).where("reject_reason is not null")


def check_batch_contract(ascans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split records by whether their whole buffer is consistent."""
    faults = batch_faults(ascans)
    return ascans.join(faults, BATCH_KEYS, "left_anti"), ascans.join(faults, BATCH_KEYS, "inner")


def validate_block_contract(ascans: DataFrame) -> DataFrame:
    """Per block: all records share one stream contract and record indices are contiguous."""
    def one(name: str, *values: str) -> Column:
        packed = F.struct(*values) if len(values) > 1 else F.col(values[0])
        return (F.min(packed) == F.max(packed)).alias(name)

    stats = ascans.groupBy(*BATCH_KEYS).agg(
        one("channel", "channel"),
        one("sample_format", "sample_format"),
        one("sample_rate_hz", "sample_rate_hz"),
        one("record_length", "record_length"),
        one("segments", "up_segment", "down_segment"),
        F.count(F.lit(1)).alias("n"),
        F.min("record_index_in_buffer").alias("first"),
        F.max("record_index_in_buffer").alias("last"),
        F.count_distinct("record_index_in_buffer").alias("distinct"),
    )
    rules = [(F.col(c), c) for c in ("channel", "sample_format", "sample_rate_hz", "record_length", "segments")]
    contiguous = (F.col("first") == 0) & (F.col("last") + 1 == F.col("n")) & (F.col("distinct") == F.col("n"))
    reason = first_reason([*rules, (contiguous, "record_index")])
    return stats.select(*BATCH_KEYS, reason.isNull().alias("ok"), reason.alias("reason"))


def full_scale(columns: list[str]) -> Column:
    """A record's samples as full-scale doubles, from an array or from a packed payload."""
    samples = F.col("samples") if "samples" in columns else unpack_samples(F.col("payload"))
    return normalize_samples(decode_samples(samples, F.col("sample_format")))


def extract_segments(ascans: DataFrame) -> DataFrame:
    """Two rows per record, of arrays or packed: the UP and DOWN slices as full-scale doubles."""
    values = full_scale(ascans.columns)
    both = F.array(*[
        F.struct(F.lit(side).alias("seg"), slice_segment(F.col("_values"), F.col(f"{side}_segment")).alias("values"))
        for side in ("up", "down")
    ])
    kept = [c for c in ascans.columns if c not in ("samples", "payload")]
    return (
        ascans.withColumn("_values", values).select(*kept, F.explode(both).alias("_s"))
        .select(*kept, "_s.seg", "_s.values")
    )


def remove_dc(segments: DataFrame, *, enabled: bool = True) -> DataFrame:
    if not enabled:
        return segments
    total = F.aggregate("values", F.lit(0.0), lambda acc, v: acc + v)
    return (
        segments.withColumn("_mean", total / F.size("values"))
        .withColumn("values", F.transform("values", lambda v: v - F.col("_mean"))).drop("_mean")
    )


def apply_polarity(segments: DataFrame, *, mode: str = "invert_down") -> DataFrame:
    if mode != "invert_down":
        return segments
    flipped = F.transform("values", lambda v: -v)
    return segments.withColumn("values", F.when(F.col("seg") == "down", flipped).otherwise(F.col("values")))


def apply_window(segments: DataFrame, function: str = "hann") -> DataFrame:
    """Weight each segment by the symmetric window of its own length."""
    length = F.size("values")
    weighted = F.transform("values", lambda v, i: v * window_weight(function, i, length))
    return segments.withColumn("values", weighted)


def window_table(lengths: SparkSession | DataFrame, function: str, n: int | str) -> DataFrame:
    """Rows (n, idx, w). ``lengths`` is a session with one ``n``, or a frame whose column ``n`` holds lengths."""
    if isinstance(lengths, SparkSession):
        sizes = lengths.range(1).select(F.lit(n).cast("long").alias("n"))
    else:
        sizes = lengths.select(F.col(n).cast("long").alias("n")).distinct()
    rows = sizes.where("n > 0").select("n", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("idx"))
    return rows.withColumn("w", window_weight(function, F.col("idx"), F.col("n")))


def coherent_sum(window: DataFrame) -> DataFrame:
    return window.groupBy("n").agg(F.greatest(F.sum("w"), F.lit(1.0)).alias("coherent"))


def select_record(ascans: DataFrame, record_index: int, *, width: int) -> DataFrame:
    """The operator-selected record of every buffer, of arrays or packed, with its full-scale waveform."""
    chosen = min(record_index, width - 1) if width > 0 else 0
    return ascans.where(F.col("record_index_in_buffer") == chosen).withColumn("waveform", full_scale(ascans.columns))
