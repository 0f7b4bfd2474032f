"""Sample decoding and segment expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from beamfold.schemas import OFFSET_BINARY_12


def decode_samples(samples: Column, sample_format: Column) -> Column:
    """Stored 16-bit codes to signed codes (``array<int>``)."""
    offset_binary = F.transform(samples, lambda s: s.cast("int").bitwiseAND(F.lit(0xFFF0)) - F.lit(32768))
    signed = F.transform(samples, lambda s: s.cast("int"))
    return F.when(sample_format == F.lit(OFFSET_BINARY_12), offset_binary).otherwise(signed)


def normalize_samples(samples: Column) -> Column:
    """Signed codes to full scale, [-1, 1)."""
    return F.transform(samples, lambda s: s.cast("double") / F.lit(32768.0))


def decode_left_aligned(code: Column, bits: Column) -> Column:
    """A left-aligned ``bits``-wide unsigned code to a signed full-scale 16-bit value."""
    unsigned = code.cast("long").bitwiseAND(F.lit(0xFFFF))
    scale = F.pow(F.lit(2.0), F.lit(16) - bits).cast("long")
    centre = F.pow(F.lit(2.0), bits - F.lit(1)).cast("long")
    value = (F.floor(unsigned / scale) - centre) * scale
    clamped = F.greatest(F.least(value, F.lit(32767)), F.lit(-32768))
    return F.when(bits.between(1, 16), clamped).otherwise(F.lit(0)).cast("int")


def segment_from_start_length(start: Column, length: Column) -> Column:
    """Half-open ``[start, start + length)``; a 32-bit overflow gives the empty segment."""
    end = start.cast("long") + length.cast("long")
    fits = end <= F.lit(0xFFFFFFFF)
    return F.struct(
        F.when(fits, start.cast("long")).otherwise(F.lit(0)).cast("long").alias("start"),
        F.when(fits, end).otherwise(F.lit(0)).cast("long").alias("end_excl"),
    )


def valid_segment(segment: Column, record_length: Column) -> Column:
    start, end = segment.getField("start"), segment.getField("end_excl")
    return F.coalesce((start >= 0) & (start < end) & (end <= record_length), F.lit(False))


def slice_segment(samples: Column, segment: Column) -> Column:
    start, end = segment.getField("start"), segment.getField("end_excl")
    return F.slice(samples, (start + 1).cast("int"), (end - start).cast("int"))


def zero_pad(values: Column, fft_length: int | Column) -> Column:
    """Pad with zeros up to the transform length; a longer array has no valid padding (NULL)."""
    length = F.lit(fft_length) if isinstance(fft_length, int) else fft_length
    missing = (length - F.size(values)).cast("int")
    return F.when(missing >= 0, F.concat(values, F.array_repeat(F.lit(0.0), missing)))
