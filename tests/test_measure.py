import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from beamfold.functions.kernels import pack_samples, unpack_samples
from beamfold.operators import measure, records, spectra
from beamfold.operators.trajectory import stamp_raster
from tests.scenes import OFFSET_BINARY_12, SMALL, ascan_row, ascans, config, to_offset_binary, tone_record

UP_BIN = 37 * SMALL["fft"] / (SMALL["up"][1] - SMALL["up"][0])
DOWN_BIN = 43 * SMALL["fft"] / (SMALL["down"][1] - SMALL["down"][0])


def scene(spark, count=8, **changes):
    rows = [
        ascan_row(i, tone_record(4096, SMALL["up"], SMALL["down"], 0.03 * i), up=SMALL["up"], down=SMALL["down"], **changes)
        for i in range(1, count + 1)
    ]
    return ascans(spark, rows)


def test_tones_range_and_velocity(spark):
    cfg = config(spark)
    rows = measure.measure_ascans(stamp_raster(scene(spark), cfg), cfg).collect()
    assert len(rows) == 8
    for row in rows:
        assert abs(row.up_peak.peak_bin - UP_BIN) < 0.75
        assert abs(row.down_peak.peak_bin - DOWN_BIN) < 0.75
        assert row.measurement_valid and row.point.valid
        assert row.distance_m > 0 and row.velocity_mps < 0
        assert math.isclose(
            math.sqrt(row.point.x ** 2 + row.point.y ** 2 + row.point.z ** 2), row.distance_m, rel_tol=1e-9)


def test_offset_binary_measures_like_signed(spark):
    cfg = config(spark)
    coarse = [tone_record(4096, SMALL["up"], SMALL["down"]) & np.int16(-16)]
    signed = ascans(spark, [ascan_row(1, coarse[0], up=SMALL["up"], down=SMALL["down"])])
    offset = ascans(spark, [ascan_row(1, to_offset_binary(coarse[0]), up=SMALL["up"], down=SMALL["down"], fmt=OFFSET_BINARY_12)])
    peaks = [measure.measure_ascans(df, cfg).select("up_peak", "down_peak").first() for df in (signed, offset)]
    assert peaks[0] == peaks[1]


def test_packed_payload_is_equivalent(spark):
    cfg = config(spark)
    df = scene(spark)
    packed = df.withColumn("payload", pack_samples(F.col("samples"))).drop("samples")
    again = packed.withColumn("samples", unpack_samples(F.col("payload")))
    assert again.select("frame_id", "samples").orderBy("frame_id").collect() == df.select(
        "frame_id", "samples").orderBy("frame_id").collect()
    columns = ["frame_id", "up_peak", "down_peak", "distance_m"]
    left = measure.measure_ascans(df, cfg).select(*columns).orderBy("frame_id").collect()
    right = measure.measure_ascans(packed, cfg).select(*columns).orderBy("frame_id").collect()
    assert left == right


def test_threshold_equality_is_a_reject(spark):
    df = scene(spark, 1)
    level = measure.measure_ascans(df, config(spark, peak_start=40, peak_end=50)).first().up_peak
    discrete = spectra_level(spark, df, level.discrete_bin)
    kept = spark.createDataFrame([("s0", 1, "up", 15.5, level.discrete_bin, discrete)],
                                 "session_id string, frame_id long, seg string, coherent double, best_bin int, best_db double")
    row = spectra.peak_threshold(kept, threshold_db=discrete).first()
    assert (row.discrete_bin, row.valid, row.state, row.peak_bin) == (-1, False, "invalid", None)
    assert spectra.peak_threshold(kept, threshold_db=discrete - 1e-9).first().valid


def spectra_level(spark, df, k):
    segs = records.apply_window(records.apply_polarity(records.remove_dc(records.extract_segments(df))))
    spec = spectra.spectrum(segs, 2048).where((F.col("seg") == "up") & (F.col("k") == k)).first()
    coherent = float(np.hanning(1728).sum())
    return 20 * math.log10(2 * math.hypot(spec.re, spec.im) / coherent)


def test_silence_is_invalid(spark):
    cfg = config(spark)
    df = ascans(spark, [ascan_row(1, np.zeros(4096, np.int16), up=SMALL["up"], down=SMALL["down"])])
    row = measure.measure_ascans(stamp_raster(df, cfg), cfg).first()
    assert row.up_peak.discrete_bin == -1 and not row.measurement_valid
    assert row.distance_m is None and not row.point.valid and row.point.x is None


def test_missing_position_keeps_the_measurement(spark):
    row = measure.measure_ascans(scene(spark, 1), config(spark)).first()
    assert row.measurement_valid and row.distance_m is not None and not row.point.valid


@pytest.mark.parametrize("offset", [-0.4, -0.1, 0.0, 0.25, 0.49])
def test_parabolic_refinement_recovers_the_offset(spark, offset):
    centre, coherent = 20, 15.5
    rows = []
    for k in range(10, 31):
        level = -20.0 - 8.0 * ((k - centre) - offset) ** 2 if abs(k - centre) <= 1 else -120.0
        rows.append(("s0", 1, "up", k, 10 ** (level / 20) * coherent / 2, 0.0, coherent))
    spec = spark.createDataFrame(rows, "session_id string, frame_id long, seg string, k int, re double, im double, coherent double")

    def refined(start, end):
        best = spectra.peak_threshold(spectra.peak_bin_search(spec, start=start, end=end), threshold_db=-60.0)
        return spectra.refine_peak(spec, best, start=start, end=end).first()

    assert abs(refined(12, 28).peak_bin - (centre + offset)) < 1e-6
    assert refined(centre, 28).peak_bin == centre  # no refinement on the edge of the search range


def test_native_and_arrow_spectra_agree(spark):
    segs = records.extract_segments(ascans(spark, [
        ascan_row(1, tone_record(128, (0, 60), (64, 124)), up=(0, 60), down=(64, 124))]))
    pair = [
        {(r.seg, r.k): (r.re, r.im) for r in spectra.spectrum(segs, 64, method=m).collect()} for m in ("arrow", "sql")]
    assert pair[0].keys() == pair[1].keys() and len(pair[0]) == 66
    for key, (re, im) in pair[0].items():
        assert abs(re - pair[1][key][0]) < 1e-9 and abs(im - pair[1][key][1]) < 1e-9


def test_mixed_configurations_in_one_batch(spark):
    cfg = config(spark).unionByName(config(spark, config_revision=2, window_function="blackman", fft_length=4096, peak_end=1800))
    df = scene(spark, 8).withColumn("config_revision", F.col("frame_id") % 2 + 1)
    rows = measure.measure_ascans(df, cfg).collect()
    for row in rows:
        assert abs(row.up_peak.peak_bin - UP_BIN * (2 if row.config_revision == 2 else 1)) < 1.5


def test_batch_rejects_whole_buffer(spark):
    df = scene(spark, 8).withColumn("channel", F.when(F.col("frame_id") == 3, "b").otherwise("a"))
    measured, rejected = measure.measure_batches(df, config(spark))
    assert sorted(r.frame_id for r in measured.collect()) == [5, 6, 7, 8]
    assert [(r.dma_buffer_sequence, r.bad_records, r.reject_reason) for r in rejected.collect()] == [(0, 1, "channel")]
    single = measure.measure_ascans(df, config(spark)).where("frame_id > 4").select("frame_id", "up_peak", "distance_m")
    assert sorted(single.collect()) == sorted(measured.select("frame_id", "up_peak", "distance_m").collect())
    good, bad = records.check_batch_contract(df.where("frame_id <> 6"))
    assert {r.dma_buffer_sequence for r in good.collect()} == {0}
    assert {r.reject_reason for r in bad.collect()} == {"record_count"}


def test_samples_do_not_shuffle(spark):
    cfg = config(spark)
    df = scene(spark)
    plan = measure.measure_ascans(df, cfg)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan and "Aggregate" not in plan


def test_revisions_belong_to_their_session(spark):
    cfg = config(spark).withColumn("session_id", F.lit("s0")).unionByName(config(spark, distance_scale=2.0).withColumn("session_id", F.lit("s1")))
    one = scene(spark, 2)
    both = one.unionByName(one.withColumn("session_id", F.lit("s1")))
    found = {(r.session_id, r.frame_id): r.distance_m for r in measure.measure_ascans(both, cfg).collect()}
    assert len(found) == 4 and all(abs(found["s1", i] - 2 * found["s0", i]) < 1e-9 for i in (1, 2))


def test_missing_parameters_reject_the_record(spark):
    cfg = config(spark).withColumn("fft_length", F.lit(None).cast("long"))
    measured, rejected = measure.measure_batches(scene(spark, 4), cfg)
    assert measured.count() == 0 and [r.reject_reason for r in rejected.collect()] == ["incomplete_config"]
    assert measure.measure_ascans(scene(spark, 4), cfg).count() == 0


def test_segments_and_selected_records_take_packed_rows(spark):

    df = ascans(spark, [ascan_row(i, np.arange(i, i + 64, dtype=np.int16) * 100, up=(0, 32), down=(32, 64)) for i in range(1, 9)])
    packed = df.withColumn("payload", pack_samples(F.col("samples"))).drop("samples")
    for function in (records.extract_segments, lambda d: records.select_record(d, 2, width=4)):
        a, b = function(df), function(packed)
        columns = [c for c in a.columns if c in b.columns and c not in ("pos", "samples")]
        assert {"values", "waveform"} & set(columns)
        assert sorted(map(str, a.select(*columns).collect())) == sorted(map(str, b.select(*columns).collect()))
