import random
import struct
import tempfile
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from beamfold.operators import packets
from beamfold.plans.packets_queries import body_packets, pack_datagram
from beamfold.session import new_folder
from beamfold.streaming import arrival, reassembly, sinks, stale

PACKET = ("receiver string, raster_frame_id long, timestamp_ns long, config_revision long, segment_count int, segment_index int, "
          "point_count int, body binary, arrival_ns long")
MS = 1_000_000


def body(value, count):
    return b"".join(struct.pack("<5f", value, 0, 0, 0, 0) for _ in range(count))


def packet(frame, segment, count, arrival_ms, points=1, stamp=7, revision=1):
    return ("r", frame, stamp, revision, count, segment, points, body(float(segment), points), (arrival_ms + 10_000) * MS)


def run_stream(spark, batches, **limits):
    """Feed each list of packets as one micro-batch and return all outcome rows."""
    reassembly.use_rocksdb(spark)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    source, out, place = f"{folder}/in", f"{folder}/out", f"{folder}/state"
    for rows in batches:
        spark.createDataFrame(rows, PACKET).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(PACKET).parquet(source)
        sinks.append_table(reassembly.reassemble_stream(stream, **limits), out, checkpoint=place).awaitTermination()
    return spark.read.parquet(out).collect()


def outcomes(rows):
    return sorted((r.outcome, r.raster_frame_id) for r in rows)


def test_stream_orders_segments_and_counts_copies(spark):
    rows = run_stream(spark, [[packet(1, 1, 2, 0), packet(1, 1, 2, 1)], [packet(1, 0, 2, 2), packet(2, 0, 1, 3, points=0)]])
    assert outcomes(rows) == [("completed", 1), ("completed", 2), ("duplicate", 1)]
    done = next(r for r in rows if r.outcome == "completed" and r.raster_frame_id == 1)
    assert bytes(done.body) == body(0.0, 1) + body(1.0, 1)
    assert next(r for r in rows if r.raster_frame_id == 2).point_count == 0


def test_stream_expires_conflicts_bounds_and_evicts(spark):
    first = [packet(1, 0, 2, 0), packet(2, 0, 2, 10), packet(2, 0, 3, 20), packet(3, 5, 2, 30), packet(4, 0, 2, 40, points=9)]
    second = [packet(5, 0, 2, 600), packet(6, 0, 2, 601), packet(7, 0, 2, 602), packet(5, 1, 2, 603), packet(7, 1, 2, 604)]
    rows = run_stream(spark, [first, second], max_inflight=2, max_points=8)
    assert outcomes(rows) == [
        ("bad_layout", 3), ("completed", 7), ("evicted", 1), ("evicted", 5), ("evicted", 6), ("expired", 2),
        ("inconsistent", 2), ("oversized", 4)]


def test_idle_frames_expire_by_the_watermark(spark):
    late = [packet(9, 0, 1, 20_000), ("other", *packet(8, 0, 1, 20_001)[1:])]
    rows = run_stream(spark, [[packet(1, 0, 2, 0)], late[1:], [("other", *packet(7, 0, 1, 40_000)[1:])]], delay="1 second")
    assert ("expired", 1) in outcomes(rows)


def test_stream_and_batch_reassembly_agree(spark):
    random.seed(5)
    rows, arrival = [], 0
    for frame in range(1, 60):
        count = random.randint(1, 4)
        segments = [s for s in range(count) if random.random() < 0.9]
        random.shuffle(segments)
        for segment in segments:
            arrival += 1
            rows.append(packet(frame, segment, count, arrival, points=random.randint(0, 5)))
    streamed = {r.raster_frame_id: (r.point_count, bytes(r.body)) for r in run_stream(spark, [rows[:70], rows[70:]])
                if r.outcome == "completed"}
    df = spark.createDataFrame(rows, PACKET).withColumnRenamed("receiver", "sender").withColumn(
        "points", packets.decode_body(F.col("body")))
    frames, outcome = packets.reassemble_batch(df)
    batch = {r.raster_frame_id: [p.x for p in r.points] for r in frames.collect()}
    assert set(batch) == set(streamed)
    for frame, values in batch.items():
        assert [struct.unpack_from("<f", streamed[frame][1], 20 * i)[0] for i in range(streamed[frame][0])] == values
    assert {r.raster_frame_id for r in outcome.where("outcome = 'incomplete'").collect()}.isdisjoint(batch)


def test_decode_rejects_damage(spark):
    good = struct.pack("<4sHHQQQHHHH", b"FMCW", 2, 40, 9, 8, 7, 1, 0, 2, 20) + body(1.5, 2)
    cases = {
        "ok": good, "version": good[:4] + b"\1\0" + good[6:], "short_or_magic": b"XMCW" + good[4:],
        "point_stride": good[:38] + b"\x18\0" + good[40:], "size": good[:-1], "segment": good[:32] + b"\0\0" + good[34:],
        "unsigned_range": good[:8] + b"\xff" * 8 + good[16:], "header_bytes": good[:6] + b"\x29\0" + good[8:],
    }
    raw = spark.createDataFrame([(name, value) for name, value in cases.items()] + [("short_or_magic", b"FM")], "name string, payload binary")
    kept, bad = packets.decode_packets(raw)
    row = kept.first()
    assert kept.count() == 1 and row.name == "ok" and [p.x for p in row.points] == [1.5, 1.5]
    assert (row.raster_frame_id, row.timestamp_ns, row.config_revision) == (9, 8, 7)
    rejected = bad.collect()
    assert len(rejected) == len(cases) and all(r.name == r.reject_reason for r in rejected)
    bodies, _ = packets.decode_packets(raw, keep_body=True)
    assert bytes(bodies.first().body) == body(1.5, 2)


def test_packetize_empty_and_oversize(spark):
    schema = "session_id string, raster_frame_id long, points array<struct<x:double>>"
    df = spark.createDataFrame([("s", 1, []), ("s", 2, [(float(i),) for i in range(5)])], schema)
    rows = packets.packetize(df, points_per_packet=2)[0].orderBy("raster_frame_id", "segment_index").collect()
    assert [(r.raster_frame_id, r.segment_count, r.point_count) for r in rows] == [(1, 1, 0), (2, 3, 2), (2, 3, 2), (2, 3, 1)]
    assert packets.packetize(df, points_per_packet=1)[1].count() == 0
    wide = df.withColumn("points", F.when(F.col("raster_frame_id") == 2, F.array_repeat(F.struct(F.lit(1.0).alias("x")), 65536)))
    kept, rejects = packets.packetize(wide, points_per_packet=1)
    assert kept.count() == 0
    assert {(r.raster_frame_id, r.points_in_frame, r.reject_reason) for r in rejects.collect()} == {(1, None, "points"), (2, 65536, "segment_count")}


def brute_stale(frames, reset_ns):
    out, last = {}, {}
    for sender, frame, now in sorted(frames, key=lambda f: (f[2], f[1])):
        fresh = sender not in last or frame > last[sender][0] or now - last[sender][1] >= reset_ns
        if fresh:
            last[sender] = (frame, now)
        out[sender, frame, now] = not fresh
    return out


def test_stale_filter_equals_the_sequential_rule(spark):
    random.seed(11)
    frames = {}
    for i in range(1500):
        now = i * 40 * MS + random.randrange(30) * MS + (int(3e9) if i > 900 else 0)
        sender = random.choice("aaab")
        frames[sender, now] = (sender, random.choice((i, i % 90, random.randrange(50))), now)
    rows = list(frames.values())
    df = spark.createDataFrame(rows, "sender string, raster_frame_id long, arrival_ns long")
    got = {(r.sender, r.raster_frame_id, r.arrival_ns): r.stale
           for r in packets.drop_stale_frames(df, reset_s=0.5, span_s=2.0, keep_stale=True).collect()}
    assert got == brute_stale(rows, int(0.5e9))
    kept = packets.drop_stale_frames(df, reset_s=0.5, span_s=2.0)
    assert kept.count() == sum(not s for s in got.values())


def test_stale_stream_keeps_state_between_batches(spark):
    reassembly.use_rocksdb(spark)
    folder = new_folder(spark, "stale-test")
    schema = "sender string, raster_frame_id long, arrival_ns long"
    for rows in ([("a", 5, 0), ("a", 4, MS)], [("a", 5, 2 * MS), ("a", 6, 3 * MS), ("a", 1, 2_600 * MS)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = stale.drop_stale_stream(spark.readStream.schema(schema).parquet(f"{folder}/in"), reset_s=2.0)
        sinks.append_table(stream, f"{folder}/out", checkpoint=f"{folder}/state").awaitTermination()
    assert sorted(r.raster_frame_id for r in spark.read.parquet(f"{folder}/out").collect()) == [1, 5, 6]


def test_latest_snapshot_versions_carry_over(spark):
    folder = new_folder(spark, "latest-test")
    schema = "session_id string, scan_frame_index long, v long"
    for rows in ([("a", 3, 30), ("b", 1, 10)], [("a", 2, 20), ("b", 4, 40)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        sinks.latest_snapshots(stream, f"{folder}/out", checkpoint=f"{folder}/state").awaitTermination()
    rows = sinks.read_latest(spark, f"{folder}/out").select("session_id", "scan_frame_index", "v").collect()
    assert sorted(map(tuple, rows)) == [("a", 3, 30), ("b", 4, 40)]


def test_equal_frames_are_judged_one_by_one(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 1, 0), ("a", 2, 5), ("a", 2, 5), ("a", 2, 5)], "sender string, raster_frame_id long, arrival_ns long")
    marked = packets.drop_stale_frames(df, keep_stale=True)
    assert sorted((r.raster_frame_id, r.stale) for r in marked.collect()) == [(1, False), (1, True), (2, False), (2, True), (2, True)]
    assert set(packets.drop_stale_frames(df).columns) == set(df.columns) and packets.drop_stale_frames(df).count() == 2


def test_copies_of_a_segment_arrive_before_the_next_one(spark):
    """Whatever the number of parts; else frames would be completed twice."""
    rows = [(5, part, line) for line in range(1, 8) for part in (3, 19_999, 119_999, 1_199_999)]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int")
    packets = body_packets(lines).orderBy("arrival_ns").collect()
    segments = [p.segment_index for p in packets]
    assert len(segments) == 28 and segments == sorted(segments)


def test_datagrams_are_packed_without_python_objects():
    """160,000 points are 3 MB on the wire; as Python dictionaries they were some hundred."""
    names, rows = ("x", "y", "z", "intensity", "velocity"), 10_000
    values = pa.StructArray.from_arrays([pa.array(np.arange(rows * 16) + 0.5 * i) for i in range(5)], names=list(names))
    points = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * 16 + 1, 16, dtype=np.int32)), values)
    numbers = pa.array(np.arange(rows))
    tracemalloc.start()
    datagrams = pack_datagram.func(numbers, numbers, numbers, pa.array([4] * rows), pa.array([3] * rows), points)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    wanted = struct.pack("<4sHHQQQHHHH", b"FMCW", 2, 40, 7, 7, 7, 4, 3, 16, 20) + b"".join(
        struct.pack("<5f", *(7 * 16 + p + 0.5 * i for i in range(5))) for p in range(16))
    assert datagrams[7].as_py() == wanted and len(datagrams) == rows and peak < 50e6


class KeptInMemory:
    """What a stateful processor asks of Spark, with the state in a dictionary."""

    def __init__(self):
        self.state = {}

    def getMapState(self, *_):
        return KeptInMemory()

    def listTimers(self):
        return iter(())

    def registerTimer(self, _):
        pass

    def iterator(self):
        return iter(self.state.items())

    def updateValue(self, key, value):
        self.state[key] = value


def assembly():
    frames = reassembly.FrameAssembly(500, 8, 4096, 2_000_000)
    frames.init(KeptInMemory())
    return frames


def packet_chunks(chunks, rows, size):
    """Frames of two packets whose arrival goes criss-cross through the chunks."""
    for i in range(chunks):
        n = np.arange(i, chunks * rows, chunks)
        yield pd.DataFrame({
            "receiver": "r", "raster_frame_id": n // 2, "timestamp_ns": n // 2, "config_revision": 1, "segment_count": 2,
            "segment_index": n % 2, "point_count": size, "body": [bytes(20 * size) for _ in n], "arrival_ns": n * MS})


def test_a_micro_batch_does_not_stay_in_memory(monkeypatch):
    """80 MB of packets, and the same bytes of frames; a worker held all of both."""
    monkeypatch.setattr(arrival, "RUN_BYTES", 4 << 20)
    monkeypatch.setattr(reassembly, "OUT_BYTES", 2 << 20)
    held = pa.total_allocated_bytes()
    tracemalloc.start()
    completed, points, peak = 0, 0, 0
    for out in assembly().handleInputRows(("r",), packet_chunks(40, 1000, 100), None):
        assert (out["outcome"] == "completed").all()
        completed, points = completed + len(out), points + out["point_count"].sum()
        peak = max(peak, tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - held)
    tracemalloc.stop()
    assert completed == 20_000 and points == 4_000_000 and peak < 40e6


def test_outcomes_do_not_depend_on_runs(monkeypatch):
    def outcomes():
        random.seed(3)
        rows = pd.concat(packet_chunks(1, 3000, 2))
        rows = rows.loc[[i for i in range(3000) if random.random() < 0.8]]
        rows["arrival_ns"] = [a + random.randrange(8) * 2 * MS for a in rows["arrival_ns"]]
        rows = rows.sample(frac=1, random_state=4)
        found = list(assembly().handleInputRows(("r",), (rows[i:i + 50] for i in range(0, len(rows), 50)), None))
        return pd.concat(found).sort_values(["arrival_ns", "raster_frame_id", "outcome"]).reset_index(drop=True)

    whole = outcomes()
    assert {"completed", "evicted"} <= set(whole["outcome"])
    monkeypatch.setattr(arrival, "RUN_BYTES", 1 << 12)
    monkeypatch.setattr(arrival, "FAN", 3)
    monkeypatch.setattr(reassembly, "OUT_ROWS", 7)
    pd.testing.assert_frame_equal(outcomes(), whole)


def test_order_by_two_columns_over_runs_of_runs(monkeypatch, tmp_path):
    monkeypatch.setenv("SPARK_LOCAL_DIRS", str(tmp_path))
    monkeypatch.setattr(arrival, "RUN_BYTES", 1 << 10)
    monkeypatch.setattr(arrival, "FAN", 3)
    random.seed(8)
    rows = [(random.randrange(40), random.choice((None, *range(30)))) for _ in range(4000)]
    chunks = [pd.DataFrame(rows[i:i + 60], columns=stale.ORDER) for i in range(0, 4000, 60)]
    tables = list(arrival.in_order(chunks, stale.FRAMES, stale.ORDER))
    got = [tuple(r.values()) for t in tables for r in t.to_pylist()]
    assert got == sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0))
    assert max(t.nbytes for t in tables) <= 2 << 10 and not list(tmp_path.iterdir())
    with pytest.raises(ValueError, match="null"):
        list(arrival.in_order(chunks, pa.schema([pa.field(n, pa.int64(), nullable=False) for n in stale.ORDER]), stale.ORDER))
    assert list(arrival.in_order([], stale.FRAMES, stale.ORDER)) == [] and not list(tmp_path.iterdir())
