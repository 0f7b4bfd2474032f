"""Small A-scan tables with known tones, shared by the tests."""

from __future__ import annotations

import numpy as np

from beamfold.schemas import ASCANS, FULL_CHIRP_PERIOD, OFFSET_BINARY_12, SIGNED_INT16

SMALL = dict(length=4096, up=(192, 1920), down=(2112, 3840), fft=2048)


def tone_record(length: int, up: tuple, down: tuple, phase: float = 0.0, amplitude=(12000, 10000)) -> np.ndarray:
    out = np.zeros(length, np.int16)
    for (start, end), cycles, size, sign in ((up, 37, amplitude[0], 1), (down, 43, amplitude[1], -1)):
        step = 2 * np.pi * cycles * np.arange(end - start) / (end - start)
        out[start:end] = np.round(size * np.sin(step + sign * phase)).astype(np.int16)
    return out


def ascan_row(frame_id: int, samples: np.ndarray, *, up, down, records=4, session="s0", rate=1e9,
              fmt=SIGNED_INT16, channel="a", position=None, kind=FULL_CHIRP_PERIOD) -> tuple:
    sequence, index = divmod(frame_id - 1, records)
    return (session, frame_id, sequence, index, records, frame_id * 5000, 1, (frame_id, frame_id * 5000, 0, 0, True),
            position, (1, True, False, False), channel, fmt, kind, rate, len(samples), 0, len(samples), tuple(up), tuple(down),
            [int(v) for v in samples])


def ascans(spark, rows):
    return spark.createDataFrame(rows, ASCANS)


def config(spark, **changes):
    values = dict(
        config_revision=1, channel="a", sample_point=4096, up_start=192, up_end=1920, down_start=2112, down_end=3840,
        fft_length=2048, window_function="hann", remove_dc=True, invert_down=True, peak_start=2, peak_end=900,
        threshold_db=-60.0, sweep_bandwidth_hz=2e9, sweep_rate_hz=2e5, wavelength_nm=1550.0, distance_scale=1.0,
        distance_offset_m=0.0, velocity_scale=1.0, velocity_offset_mps=0.0, x_angle_offset_deg=1.25,
        y_angle_offset_deg=-0.75, x_pixel_count=4, y_line_count=2, x_start_deg=-9.0, x_end_deg=9.0, y_start_deg=-4.0,
        y_end_deg=4.0, bidirectional=False)
    values.update(changes)
    return spark.createDataFrame([tuple(values.values())], list(values))


def to_offset_binary(samples: np.ndarray) -> np.ndarray:
    """12-bit left-aligned offset-binary codes in the same two bytes."""
    return ((samples.astype(np.int32) + 32768) & 0xFFF0).astype(np.uint16).view(np.int16)


__all__ = ["OFFSET_BINARY_12", "SMALL", "ascan_row", "ascans", "config", "to_offset_binary", "tone_record"]
