import math

import pytest
from pyspark.sql import functions as F

from beamfold.operators import plots, telemetry

BATCHES = ("session_id string, sequence long, completion_ns long, wakeup_ns long, ownership_ns long, session_ns long, "
           "enqueue_ns long, start_ns long, line_done_ns long")
MS = 1_000_000


def batches(spark, ends, start=10 * MS):
    rows = [("s", i, start, start + MS, start + 2 * MS, 0, start + MS, start + 3 * MS, start + int(e * MS)) for i, e in enumerate(ends)]
    return spark.createDataFrame(rows, BATCHES)


def test_stages_clamp_and_add_up(spark):
    row = telemetry.stage_latency(batches(spark, [4.5])).first()
    assert (row.session_validation_ms, row.enqueue_dispatch_ms) == (0.0, 0.0)
    parts = ("acquisition_wakeup_ms", "digitizer_materialization_ms", "session_validation_ms", "enqueue_dispatch_ms",
             "queue_wait_ms", "compute_ms")
    assert math.isclose(sum(row[p] for p in parts), row.end_to_end_ms) and math.isclose(row.end_to_end_ms, 4.5)


def test_deadline_is_strict_and_first_maximum_wins(spark):
    latency = telemetry.stage_latency(batches(spark, [5.0, 5.000001, 7.0, 7.0, 4.0]))
    assert telemetry.deadline_misses(latency).first().deadline_misses == 3
    summary = telemetry.latency_summary(latency).first()
    assert summary.max_end_to_end_ms_sequence == 2 and math.isclose(summary.last_end_to_end_ms, 4.0)


def test_percentiles_look_at_the_last_window(spark):
    ends = [100.0 + i for i in range(50)] + [4.0 + i / 100 for i in range(100)]
    row = telemetry.rolling_percentiles(telemetry.stage_latency(batches(spark, ends)), n=100, span=16).first()
    assert row.window_batches == 100
    assert [round(v, 2) for v in (row.p50_ms, row.p95_ms, row.p99_ms)] == [4.49, 4.94, 4.98]


@pytest.mark.parametrize("alpha", [0.2, 0.9])
def test_period_average_equals_the_fold(spark, alpha):
    stamps, now = [], 1_000_000_000
    for i in range(1500):
        now += (i * 7919 % 13 + 1) * MS
        stamps.append(0 if i % 31 == 5 else now - (500 * MS if i % 57 == 3 else 0))
    df = spark.createDataFrame([("s", i, s) for i, s in enumerate(stamps)], "session_id string, sequence long, wakeup_ns long")
    got = [r.period_ema_ms for r in telemetry.period_ema(df, alpha=alpha, span=64).orderBy("sequence").collect()]
    ema, before = None, None
    for i, stamp in enumerate(stamps):
        if before and stamp > before:
            period = (stamp - before) * 1e-6
            ema = period if ema is None else alpha * period + (1 - alpha) * ema
        before = stamp
        assert (got[i] is None) == (ema is None) and (ema is None or math.isclose(got[i], ema, rel_tol=1e-9)), i


def test_accounting_needs_every_record(spark):
    delivered = spark.createDataFrame([("a", 8, 2, 0, 0, 0), ("b", 8, 2, 1, 0, 0), ("c", 8, 2, 0, 0, 0)],
                                      "session_id string, records long, batches long, dropped long, rejected long, deadline_misses long")
    measured = spark.createDataFrame([("a", 8), ("b", 8)], "session_id string, measured_records long")
    points = spark.createDataFrame([("a", 8), ("b", 8), ("d", 1)], "session_id string, valid_points long")
    rows = {r.session_id: (r.functional, r.hard_pass) for r in telemetry.accounting(delivered, measured, points).collect()}
    assert rows == {"a": (True, True), "b": (True, False), "c": (False, False), "d": (False, False)}


def test_exact_percentile_with_heavy_ties_and_outliers(spark):
    values = [5.0] * 7000 + [float(i) for i in range(1000)] + [1e300, -1e300]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranked = sorted(values)
    for q in (0.0, 0.001, 0.05, 0.5, 0.9, 0.95, 0.999, 1.0):
        expected = ranked[max(math.ceil(q * len(values)), 1) - 1]
        assert plots.nearest_rank_percentile(df, "v", q).first().percentile == expected


def test_envelope_buckets_and_gaps(spark):
    values = [1.0, float("nan"), 3.0, 2.0, float("nan"), float("nan"), 7.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "series_id string, idx long, value double")
    rows = {r.bucket: (r.low, r.high) for r in plots.envelope(df, 3).collect()}
    assert rows == {0: (1.0, 1.0), 1: (2.0, 3.0), 2: (7.0, 7.0)}
    runs = sorted((r.first_idx, r.last_idx, r.length) for r in plots.finite_runs(df, span=2).collect())
    assert runs == [(0, 0, 1), (2, 3, 2), (6, 6, 1)]
    summary = plots.series_range(df.withColumn("plot_id", F.lit(1))).first()
    assert (summary.minimum, summary.maximum, summary.longest, summary.contains_gap) == (1.0, 7.0, 7, True)


def test_flat_and_empty_heat_maps(spark):
    df = spark.createDataFrame([(1, [2.0, 2.0], [True, False]), (2, [2.0, None], [False, True])],
                               "frame int, depth array<double>, valid array<boolean>")
    rows = {r.frame: r for r in plots.heatmap_normalise(df).collect()}
    assert rows[1].normalised == [0.0, None] and rows[1].range_maximum == 3.0
    assert rows[2].normalised == [None, None] and (rows[2].range_minimum, rows[2].range_maximum) == (0.0, 1.0)


def nearest_rank(values, q):
    ranked = sorted(values, key=lambda v: (math.isnan(v), v))
    return ranked[max(math.ceil(q * len(ranked)), 1) - 1]


def test_percentiles_of_any_spread_are_exact(spark):
    import random
    rng = random.Random(8)
    tables = {
        "spread": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-320, 308) for _ in range(3000)],
        "close": [1.0 + rng.randrange(50) * 2.0 ** -52 for _ in range(900)],
        "ends": [float("inf"), float("-inf"), float("nan"), 0.0, 5e-324, -5e-324, 1.7e308, -1.7e308] * 3,
        "ties": [rng.choice([2.5, 2.5, 3.0, -1.0]) for _ in range(700)], "one": [7.0],
    }
    df = spark.createDataFrame([(k, v) for k, vs in tables.items() for v in vs] + [("null", None), ("one", None)], "k string, v double")
    qs = (0.0, 0.1, 0.5, 0.95, 1.0)
    found = {(r.k, r.q): (r.percentile, r.n) for r in plots.nearest_rank_percentile(df, "v", qs, keys=["k"]).collect()}
    assert {k: repr(v) for k, v in found.items()} == {(k, q): repr((nearest_rank(vs, q), len(vs))) for k, vs in tables.items() for q in qs}
    whole = [2**62 + rng.randrange(-5, 5) for _ in range(500)] + [-(2**60), 0]
    longs = spark.createDataFrame([(v,) for v in whole], "v long")
    assert [r.percentile for r in plots.nearest_rank_percentile(longs, "v", qs).orderBy("q").collect()] == [nearest_rank(whole, q) for q in qs]
    assert plots.nearest_rank_percentile(df.limit(0), "v", 0.5).count() == 0


def test_a_million_distinct_values_meet_in_counts_only(spark, monkeypatch):
    sizes, kept = [], plots.stage
    monkeypatch.setattr(plots, "stage", lambda df, name: sizes.append(df) or kept(df, name))
    df = spark.range(1_000_000).selectExpr("cast(pmod(id * 7919, 1000003) as double) / 7 v", "id % 2 k")
    found = {(r.k, r.q): r.percentile for r in plots.nearest_rank_percentile(df, "v", (0.5, 0.95), keys=["k"]).collect()}
    for k in range(2):
        ranked = sorted((i * 7919 % 1000003) / 7 for i in range(k, 1_000_000, 2))
        assert [found[k, q] for q in (0.5, 0.95)] == [ranked[math.ceil(q * len(ranked)) - 1] for q in (0.5, 0.95)]
    assert len(sizes) <= 4
    rows = spark.range(1_000_000).selectExpr("cast(pmod(id * 7919, 1000003) as double) / 7 v")
    parts = rows.select(plots._even_bucket(F.col("v"), F.lit(0.0), F.lit(150000.0), False).alias("b")).distinct().count()
    assert parts <= plots.BUCKETS
