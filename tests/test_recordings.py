import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from beamfold.plans import fixtures
from beamfold.schemas import STANDARD_COORDINATE_FRAME
from beamfold.streaming import sinks
from beamfold.sources import clouds_io, measured, recordings, replay, sessions, waveforms
from tests.scenes import ascan_row, ascans, config


def block(sequence, records=3, length=64):
    return pd.DataFrame({
        "frame_id": sequence * records + np.arange(records) + 1, "host_timestamp_ns": 5, "config_revision": 1,
        "record_index_in_buffer": np.arange(records), "dma_buffer_sequence": sequence,
        "samples": [np.full(length, 100 * sequence + r, np.int16) for r in range(records)]})


def part(folder, name, version, blocks, tail=b""):
    data = fixtures.stream_header(version, 64, 3) + b"".join(fixtures.block_bytes(version, b) for b in blocks) + tail
    with open(os.path.join(folder, name), "wb") as out:
        out.write(data)


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_two_parts_with_one_block_each(spark):
    place = folder()
    part(place, "a.raw.0000.bin", 3, [block(0)])
    part(place, "a.raw.0001.bin", 3, [block(1)])
    part(place, "a.raw.0003.bin", 3, [block(3)])  # behind a gap: not part of the recording
    rows, batches, rejects = recordings.read_recordings(spark, place)
    assert [(r.part, r.block, r.reject_reason) for r in rejects.collect()] == [(3, None, "not_contiguous")]
    assert {(r.frame_id, r.samples[0]) for r in rows.collect()} == {(i + 1, 100 * (i // 3) + i % 3) for i in range(6)}
    assert {r.sequence for r in batches.collect()} == {0, 1}
    packed, *_ = recordings.read_recordings(spark, place, packed=True)
    assert {len(r.payload) for r in packed.collect()} == {128}


def test_incompatible_part_ends_the_recording(spark):
    place = folder()
    part(place, "a.raw.0000.bin", 3, [block(0)])
    with open(os.path.join(place, "a.raw.0001.bin"), "wb") as out:
        out.write(fixtures.stream_header(3, 32, 3) + fixtures.block_bytes(3, block(1, length=32)))
    assert recordings.read_recordings(spark, place)[0].count() == 3


def test_legacy_versions_need_the_standard_frame(spark):
    place = folder()
    for name, version in (("good", 1), ("older", 2), ("alien", 2), ("bare", 1)):
        part(place, f"{name}.raw.0000.bin", version, [block(0)])
    for name, frame in (("good", STANDARD_COORDINATE_FRAME), ("older", STANDARD_COORDINATE_FRAME), ("alien", "camera")):
        with open(os.path.join(place, f"{name}.raw.json"), "w") as out:
            out.write('{"session_id": "%s", "coordinate_frame": "%s"}' % (name, frame))
    sidecars = sessions.read_sessions(spark, place)
    rows, _, rejects = recordings.read_recordings(spark, place, sessions=sidecars)
    assert {(r.stem.rsplit("/", 1)[-1], r.part, r.block, r.reject_reason) for r in rejects.collect()} == {
        ("alien", 0, None, "coordinate_frame"), ("bare", 0, None, "no_coordinate_frame")}
    assert {r.session_id for r in rows.select("session_id").distinct().collect()} == {"good", "older"}
    headers = recordings.read_stream_headers(recordings.list_parts(spark, place))
    _, bad = recordings.coordinate_gate(headers, sidecars)
    assert {(r.stem.rsplit("/", 1)[-1], r.reject_reason) for r in bad.collect()} == {
        ("alien", "coordinate_frame"), ("bare", "no_coordinate_frame")}
    rows, _, rejects = recordings.read_recordings(spark, place)
    assert rows.count() == 0 and rejects.count() == 4
    assert recordings.read_recordings(spark, place, formats=("v3",))[2].count() == 0


def test_damaged_blocks_are_quarantined(spark):
    place = folder()
    raw = [bytearray(fixtures.block_bytes(3, block(i))) for i in range(5)]
    raw[1][48:52] = (200000).to_bytes(4, "little")
    raw[2][0:4] = b"oops"
    raw[3][8:12] = (1).to_bytes(4, "little")
    with open(os.path.join(place, "a.raw.0000.bin"), "wb") as out:
        out.write(fixtures.stream_header(3, 64, 3) + b"".join(map(bytes, raw))[:-10])
    part(place, "b.raw.0000.bin", 3, [], tail=b"xx")
    headers = recordings.read_stream_headers(recordings.list_parts(spark, place))
    good, bad = recordings.quarantine_blocks(recordings.scan_blocks(headers))
    assert [(r.block, int(r.sequence)) for r in good.collect()] == [(0, 0)]
    assert {(r.stem[-1], r.block, r.reject_reason) for r in bad.collect()} == {
        ("a", 1, "record_count"), ("a", 2, "block_magic"), ("a", 3, "header_bytes"), ("a", 4, "truncated_payload"),
        ("b", 0, "truncated_header")}


def test_store_round_trip_keeps_buffers_whole(spark):
    df = ascans(spark, [ascan_row(i, np.arange(i, i + 64, dtype=np.int16), up=(0, 32), down=(32, 64)) for i in range(1, 41)])
    place = os.path.join(folder(), "store")
    recordings.write_ascans(df, place, split_gb=2e-6)
    stored = recordings.read_ascans(spark, place, unpack=True)
    files = stored.withColumn("f", F.col("_metadata.file_path")).groupBy("dma_buffer_sequence").agg(F.count_distinct("f").alias("n"))
    assert {r.n for r in files.collect()} == {1}
    columns = ["frame_id", "samples", "up_segment"]
    assert stored.select(*columns).orderBy("frame_id").collect() == df.select(*columns).orderBy("frame_id").collect()


def test_replay_restamps_and_loops(spark):
    df = ascans(spark, [ascan_row(i, np.zeros(64, np.int16), up=(0, 32), down=(32, 64)) for i in (5, 6, 7, 8, 13, 14)])
    rows = replay.renumber(df, loops=2).orderBy("frame_id").collect()
    assert [r.frame_id for r in rows] == [r.trigger.sequence for r in rows] == list(range(1, 13))
    assert [r.dma_buffer_sequence for r in rows] == [0] * 4 + [1] * 2 + [2] * 4 + [3] * 2
    assert [(r.record_index_in_buffer, r.records_in_buffer) for r in rows[:6]] == [(0, 4), (1, 4), (2, 4), (3, 4), (0, 2), (1, 2)]


def test_waveform_text(spark):
    place = folder()
    texts = {"good": "﻿SPS 5e4\r\n\r\n1 2 0.5\r\n 3\t4 0 \r\n", "row": "sps 1\n1 2 3\n1 nan 0\n", "head": "rate 5\n1 2 3\n4 5 6\n",
             "short": "sps 10\n1 2 3\n", "zero": "sps 0\n1 2 3\n4 5 6\n"}
    for name, text in texts.items():
        with open(os.path.join(place, f"{name}.txt"), "w", newline="") as out:
            out.write(text)
    rows, issues = waveforms.read_waveform(spark, place)
    assert [(r.idx, r.x, r.y, r.trigger, r.sample_rate_hz) for r in rows.orderBy("idx").collect()] == [
        (0, 1.0, 2.0, True, 5e4), (1, 3.0, 4.0, False, 5e4)]
    name = F.regexp_extract("file", r"(\w+)\.txt", 1)
    assert {(r[0], r[1], r[2]) for r in issues.select(name, "line", "message").collect()} == {
        ("row", 3, "bad_row"), ("head", 1, "bad_header"), ("short", 1, "too_few_points"), ("zero", 1, "bad_header")}


def test_incomplete_clouds_are_not_stored(spark):
    schema = "session_id string, width int, height int, complete boolean, points array<struct<x:double,valid:boolean>>"
    df = spark.createDataFrame([("a", 1, 1, True, [(1.0, True)]), ("b", 1, 1, False, [(1.0, True)]), ("c", 2, 1, True, [(1.0, True)])], schema)
    place = os.path.join(folder(), "clouds")
    clouds_io.write_clouds(df, place)
    assert [r.session_id for r in clouds_io.read_clouds(spark, place).collect()] == ["a"]


def test_session_ids_stay_text(spark):
    df = ascans(spark, [ascan_row(i, np.full(64, i, np.int16), up=(0, 32), down=(32, 64), session=s) for i, s in ((1, "007"), (2, "8"))])
    place = os.path.join(folder(), "store")
    recordings.write_ascans(df, place)
    assert {(r.session_id, r.frame_id) for r in recordings.read_ascans(spark, place).collect()} == {("007", 1), ("8", 2)}
    assert {r.session_id: r.bytes_written for r in sessions.write_manifest(recordings.read_ascans(spark, place), None, None).collect()} == {"007": 128, "8": 128}


def test_stems_are_plain_paths(spark):
    place = os.path.join(folder(), "my dir+1")
    os.makedirs(place)
    with open(os.path.join(place, "g.raw.json"), "w") as out:
        out.write('{"session_id": "g"}')
    assert sessions.read_sessions(spark, place).first().stem.endswith("/my dir+1/g")


def test_blank_waveform_is_an_issue(spark):
    place = folder()
    for name, text in {"blank": " \n\n", "good": "sps 10\n1 2 0\n3 4 1\n"}.items():
        with open(os.path.join(place, f"{name}.txt"), "w") as out:
            out.write(text)
    rows, issues = waveforms.read_waveform(spark, place)
    assert rows.count() == 2 and [(r.line, r.message) for r in issues.collect()] == [(0, "empty_file")]


def test_v1_records_are_numbered_over_all_parts(spark):
    place = folder()
    part(place, "a.raw.0000.bin", 1, [block(0)])
    part(place, "a.raw.0001.bin", 1, [block(1), block(2)])
    with open(os.path.join(place, "a.raw.json"), "w") as out:
        out.write('{"session_id": "a", "coordinate_frame": "%s"}' % STANDARD_COORDINATE_FRAME)
    rows, batches, _ = recordings.read_recordings(spark, place, sessions=sessions.read_sessions(spark, place), task_bytes=300)
    assert sorted((r.dma_buffer_sequence, r.frame_id) for r in rows.collect()) == [(i, i + 1) for i in range(9)]
    assert sorted(r.sequence for r in batches.collect()) == list(range(9))


def test_values_no_row_can_hold_reject_the_block(spark):
    place = folder()
    spoil = [(), (120, 2**64 - 1, 8), (120 + 92, 9, 1), (120 + 95, 2, 1), (120 + 96 + 56, 2**31, 4), (108, 3_000_000_000, 4), (100, 2**32 - 1, 4)]
    raw = [bytearray(fixtures.block_bytes(3, block(i))) for i in range(len(spoil))]
    for data, change in zip(raw, spoil):
        if change:
            at, value, size = change
            data[at:at + size] = value.to_bytes(size, "little")
    with open(os.path.join(place, "a.raw.0000.bin"), "wb") as out:
        out.write(fixtures.stream_header(3, 64, 3) + b"".join(map(bytes, raw)))
    part(place, "b.raw.0000.bin", 1, [block(0)])
    with open(os.path.join(place, "b.raw.json"), "w") as out:
        out.write('{"session_id": "b", "coordinate_frame": "%s"}' % STANDARD_COORDINATE_FRAME)
    with open(os.path.join(place, "b.raw.0000.bin"), "r+b") as out:
        out.seek(36 + 12)
        out.write(b"\xff" * 8)  # the first record's frame id
    with open(os.path.join(place, "c.raw.0000.bin"), "wb") as out:
        out.write(b"FMCWRAW9")
    rows, batches, rejects = recordings.read_recordings(spark, place, sessions=sessions.read_sessions(spark, place))
    assert {(r.stem[-1], r.block, r.reject_reason) for r in rejects.collect()} == {
        ("a", 1, "record_unsigned_range"), ("a", 2, "trajectory"), ("a", 3, "trajectory"), ("a", 4, "record_index_range"), ("a", 5, "segment_range"),
        ("b", 0, "record_unsigned_range"), ("c", None, "stream_magic")}
    assert {(r.session_id, r.frame_id) for r in rows.collect()} == {("a", f) for f in (1, 2, 3, 19, 20, 21)} | {("b", 2), ("b", 3)}
    assert batches.count() == 4 and max(r.post_trigger_samples for r in rows.collect()) == 2**32 - 1


def test_replay_source_keeps_order_paces_and_restarts(spark):
    df = ascans(spark, [ascan_row(i, np.full(64, i, np.int16), up=(0, 32), down=(32, 64)) for i in range(1, 41)])
    place = os.path.join(folder(), "replay")
    replay.publish_replay(df, place, loops=2, buffers_per_tick=1)
    out, checkpoint, seen = os.path.join(folder(), "out"), folder(), []

    def run(stream, times):
        query = stream.writeStream.foreachBatch(lambda batch, n: seen.append([r.frame_id for r in batch.collect()])).option("checkpointLocation", checkpoint).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run(replay.replay_stream(spark, place, ticks_per_trigger=3), 0)
    assert len(seen) == 7 and [f for batch in seen for f in sorted(batch)] == list(range(1, 81))
    assert [max(batch) for batch in seen] == sorted(max(batch) for batch in seen)
    replay.publish_replay(df, place + "2", loops=3, buffers_per_tick=1)
    for tick in range(20, 30):
        os.rename(f"{place}2/tick={tick}", f"{place}/tick={tick}")
    seen.clear()
    run(replay.replay_stream(spark, place, ticks_per_trigger=4), 0)
    assert [sorted(batch) for batch in seen if batch] == [list(range(81, 97)), list(range(97, 113)), list(range(113, 121))]
    sinks.drain_table(replay.replay_stream(spark, place, ticks_per_trigger=50, first_tick=28), out)
    rows = spark.read.parquet(out).orderBy("frame_id").collect()
    assert [r.frame_id for r in rows] == list(range(113, 121)) and rows[0].samples == [33] * 64


def test_replay_cuts_single_records_into_buffers(spark):
    df = ascans(spark, [ascan_row(i, np.full(64, i, np.int16), up=(0, 32), down=(32, 64)) for i in range(1, 8)])
    single = df.withColumns({"dma_buffer_sequence": F.col("frame_id") - 1, "record_index_in_buffer": F.lit(0), "records_in_buffer": F.lit(1)})
    rows = replay.renumber(single, loops=2, records_per_buffer=4).orderBy("frame_id").collect()
    assert [(r.dma_buffer_sequence, r.record_index_in_buffer, r.records_in_buffer) for r in rows] == [(i // 4, i % 4, 4 if i < 12 else 2) for i in range(14)]
    assert [r.samples[0] for r in rows] == [*range(1, 8)] * 2


def test_fused_scan_measures_like_records_read_and_measured(spark):
    place = folder()
    rng = np.random.default_rng(3)
    rows = [block(i) for i in range(4)]
    for b in rows:
        b["samples"] = [rng.integers(-9000, 9000, 64).astype(np.int16) for _ in range(3)]
    rows[1]["config_revision"] = [1, 2, 1]
    rows[2]["config_revision"] = 9  # unknown
    for version in (2, 3):
        part(place, f"s{version}.raw.0000.bin", version, rows)
        with open(os.path.join(place, f"s{version}.raw.json"), "w") as out:
            out.write('{"session_id": "s%d", "coordinate_frame": "%s"}' % (version, STANDARD_COORDINATE_FRAME))
    raw = bytearray(fixtures.block_bytes(3, rows[0]))
    raw[72:76] = (7).to_bytes(4, "little")  # frame kind
    with open(os.path.join(place, "kind.raw.0000.bin"), "wb") as out:
        out.write(fixtures.stream_header(3, 64, 3) + bytes(raw) + b"tail")
    cfg = config(spark, sample_point=64, up_start=0, up_end=32, down_start=32, down_end=64, fft_length=64, peak_end=30, threshold_db=-90.0)
    cfg = cfg.unionByName(cfg.withColumns({"config_revision": F.lit(2).cast("long"), "remove_dc": F.lit(False), "window_function": F.lit("hamming")}))
    side = sessions.read_sessions(spark, place)
    read, _, lost = recordings.read_recordings(spark, place, sessions=side)
    from beamfold.operators import measure, records
    wanted = measure.measure_ascans(read, cfg)
    found, bad, rejects = measured.measure_recordings(spark, place, cfg, sessions=side, task_bytes=1)
    assert found.drop("pos", "point").orderBy("session_id", "frame_id").collect() == wanted.select(found.columns).drop("pos", "point").orderBy("session_id", "frame_id").collect()
    assert found.count() == 18 and found.where("measurement_valid").count() == 18
    reasons = lambda df: sorted((r.session_id, r.frame_id, r.reject_reason) for r in df.collect())
    assert reasons(bad) == reasons(records.check_record_contract(read, cfg)[1]) and {r[2] for r in reasons(bad)} == {"no_config", "frame_kind"}
    assert rejects.count() == lost.count() == 1


def test_batches_are_bounded_and_consistent(spark):
    from beamfold.operators import measure
    df = ascans(spark, [ascan_row(i, np.full(64, i, np.int16), up=(0, 32), down=(32, 64)) for i in range(1, 13)])
    cfg = config(spark, sample_point=64, up_start=0, up_end=32, down_start=32, down_end=64, fft_length=64, peak_end=30)
    assert measure.measure_batches(df, cfg)[1].count() == 0
    bounded = cfg.withColumn("records_per_buffer", F.lit(3))
    kept, rejected = measure.measure_batches(df, bounded)
    assert kept.count() == 0 and {(r.dma_buffer_sequence, r.bad_records, r.reject_reason) for r in rejected.collect()} == {(i, 0, "record_count") for i in range(3)}
    broken = df.where("frame_id <> 2").withColumn("channel", F.when(F.col("frame_id") == 9, "b").otherwise("a"))
    kept, rejected = measure.measure_batches(broken, bounded.withColumn("records_per_buffer", F.lit(4)))
    assert {r.dma_buffer_sequence for r in kept.collect()} == {1}
    assert {(r.dma_buffer_sequence, r.bad_records, r.reject_reason) for r in rejected.collect()} == {(0, 0, "record_count"), (2, 1, "channel")}


def test_manifest_says_how_a_session_ended(spark):
    df = ascans(spark, [ascan_row(i, np.full(64, i, np.int16), up=(0, 32), down=(32, 64), session=s) for s in ("a", "b") for i in range(1, 9)])
    place = os.path.join(folder(), "store")
    recordings.write_ascans(df, place, split_gb=1e-9)
    stored = recordings.read_ascans(spark, place).withColumn("file", F.col("_metadata.file_path"))
    closings = spark.createDataFrame([("a", True, "operator", 9), ("c", False, "disk full", None)], "session_id string, completed boolean, stop_reason string, end_timestamp_utc_ns long")
    rows = {r.session_id: r for r in sessions.write_manifest(stored, None, None, closings=closings, file="file").collect()}
    assert {k: (r.blocks_written, r.records_written, len(r.data_files), r.completed, r.stop_reason, r.end_timestamp_utc_ns) for k, r in rows.items()} == {
        "a": (2, 8, 2, True, "operator", 9), "b": (2, 8, 2, False, None, None), "c": (0, 0, 0, False, "disk full", None)}
    assert rows["a"].data_files == sorted(rows["a"].data_files) and rows["a"].data_files[0].startswith("session_id=a/part=0/")
    assert rows["b"].raw_stream.record_length == 64 and rows["c"].raw_stream is None
