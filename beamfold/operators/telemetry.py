"""Latency, rate, gap, deadline and health metrics over batches and deliveries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from beamfold.operators.ordered import Series, previous, row_index, running_sum
from beamfold.session import stage

# Stamps of a batch in processing order, and the nine latencies between pairs of them.
STAMPS = ("completion_ns", "wakeup_ns", "ownership_ns", "session_ns", "enqueue_ns", "start_ns", "line_done_ns")
STAGES = {
    "end_to_end_ms": ("completion_ns", "line_done_ns"),
    "ownership_ms": ("completion_ns", "ownership_ns"),
    "signal_ms": ("ownership_ns", "line_done_ns"),
    "acquisition_wakeup_ms": ("completion_ns", "wakeup_ns"),
    "digitizer_materialization_ms": ("wakeup_ns", "ownership_ns"),
    "session_validation_ms": ("ownership_ns", "session_ns"),
    "enqueue_dispatch_ms": ("session_ns", "enqueue_ns"),
    "queue_wait_ms": ("enqueue_ns", "start_ns"),
    "compute_ms": ("start_ns", "line_done_ns"),
}
DEADLINE_MS = 5.0
LATENCY_WINDOW = 4096


def stage_latency(batches: DataFrame) -> DataFrame:
    """Nine stage latencies; a missing or earlier stamp counts as its predecessor, so stages add up.

    Carrying the predecessor forward is a running maximum over the stamps.
    """
    ordered = {
        name: F.greatest(*[F.coalesce(F.col(s), F.lit(0)) for s in STAMPS[:i + 1]]) if i else F.col(name)
        for i, name in enumerate(STAMPS)
    }
    stages = []
    for name, (start, end) in STAGES.items():
        elapsed = (ordered[end] - ordered[start]).cast("double") * F.lit(1.0e-6)
        stages.append(F.when(ordered[start] == 0, F.lit(0.0)).otherwise(elapsed).alias(name))
    return batches.select("session_id", "sequence", *stages)


def latency_summary(latency: DataFrame) -> DataFrame:
    """Per session: last, mean and maximum of every stage, and where each watched maximum first occurred."""
    columns: list[Column] = [F.count(F.lit(1)).alias("batches")]
    for name in STAGES:
        columns += [
            F.max_by(name, "sequence").alias(f"last_{name}"), F.avg(name).alias(f"mean_{name}"),
            F.max(name).alias(f"max_{name}"),
        ]
    for name in ("end_to_end_ms", "acquisition_wakeup_ms", "compute_ms"):
        columns.append(F.min_by("sequence", F.struct(-F.col(name), F.col("sequence"))).alias(f"max_{name}_sequence"))
    return latency.groupBy("session_id").agg(*columns)


def rolling_percentiles(latency: DataFrame, *, n: int = LATENCY_WINDOW, qs: Sequence[float] = (0.5, 0.95, 0.99),
                        column: str = "end_to_end_ms", span: int = 1 << 17) -> DataFrame:
    """Nearest-rank percentiles over each session's last ``n`` batches (at most ``n`` values meet in a group)."""
    placed = row_index(
        latency.select("session_id", "sequence", column), Series(("session_id",), ("sequence",), span), "_i", total="_n")
    recent = placed.where(F.col("_i") >= F.col("_n") - n)
    ranked = recent.groupBy("session_id").agg(F.sort_array(F.collect_list(column)).alias("_v"))
    size = F.size("_v")
    values = [
        F.element_at("_v", F.greatest(F.ceil(F.lit(float(q)) * size), F.lit(1)).cast("int")).alias(f"p{round(q * 100)}_ms")
        for q in qs
    ]
    return ranked.select("session_id", size.alias("window_batches"), *values)


def deadline_misses(latency: DataFrame, *, limit_ms: float = DEADLINE_MS) -> DataFrame:
    return latency.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("batches"), F.count_if(F.col("end_to_end_ms") > limit_ms).alias("deadline_misses"))


def period_ema(batches: DataFrame, *, alpha: float = 0.2, span: int = 1 << 17) -> DataFrame:
    """Moving average of the inter-buffer period, seeded by the first positive period.

    Rows: session_id, sequence, wakeup_ns. Rows without a period keep the previous average. The fold
    ``a = alpha * p + (1 - alpha) * a`` is linear, so a block of periods is a scaled prefix sum plus its
    decayed entry value. Blocks are long enough for a whole one to decay its entry by 1e-30, so
    the two blocks before settle an entry value to the last bit and no task folds a whole session.
    """
    if not 0.0 < alpha < 1.0:
        raise ValueError("alpha must lie strictly between 0 and 1")
    keep = 1.0 - alpha
    block_length = math.ceil(30.0 * math.log(10.0) / -math.log(keep))
    series = Series(("session_id",), ("sequence",), span)
    rows = previous(batches.select("session_id", "sequence", "wakeup_ns"), series, {"_before": "wakeup_ns"})
    advanced = (F.col("_before") != 0) & (F.col("wakeup_ns") > F.col("_before"))
    period = F.when(advanced, (F.col("wakeup_ns") - F.col("_before")).cast("double") * F.lit(1.0e-6))
    rows = rows.select("session_id", "sequence", period.alias("period_ms"))
    rows = running_sum(rows, series, {"_seen": F.col("period_ms").isNotNull().cast("long")})
    rows = rows.withColumn("_block", F.floor((F.col("_seen") - 1) / block_length).cast("long"))
    rows = rows.withColumn("_place", F.pmod(F.col("_seen") - 1, F.lit(block_length)).cast("double"))
    rows = stage(rows.drop("_seen"), "periods")

    ratio, share = F.lit(keep), F.lit(alpha)
    gains = rows.where("period_ms is not null").groupBy("session_id", "_block").agg(
        F.sum(share * F.col("period_ms") * F.pow(ratio, F.lit(block_length - 1.0) - F.col("_place"))).alias("_gain"),
        F.min_by("period_ms", "sequence").alias("_first"))

    def earlier(back: int) -> DataFrame:
        return gains.select("session_id", (F.col("_block") + back).alias("_block"), F.col("_gain").alias(f"_gain{back}"),
                            F.col("_first").alias(f"_first{back}"))

    decay = F.lit(keep ** block_length)
    before_last = F.coalesce("_gain2", F.when(F.col("_block") == 1, F.col("_first1")))
    entry = F.when(F.col("_block") == 0, F.col("_first")).otherwise(F.col("_gain1") + decay * before_last)
    entries = gains.join(earlier(1), ["session_id", "_block"], "left").join(earlier(2), ["session_id", "_block"], "left")
    entries = entries.select("session_id", "_block", entry.alias("_entry"))
    inside = Window.partitionBy("session_id", "_block").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    scaled = F.sum(share * F.col("period_ms") * F.pow(ratio, -F.col("_place"))).over(inside)
    placed = rows.join(entries, ["session_id", "_block"], "left")
    average = F.pow(ratio, F.col("_place")) * (ratio * F.col("_entry") + scaled)
    out = placed.select("session_id", "sequence", "period_ms", average.alias("period_ema_ms"))
    return out.withColumn("rate_hz", F.when(F.col("period_ema_ms") > 0, F.lit(1000.0) / F.col("period_ema_ms")))


def frame_rate(rates: DataFrame, scan: DataFrame) -> DataFrame:
    """Measured frame rate and times from a line rate. Rows join on ``config_revision``."""
    joined = rates.join(scan, "config_revision")
    hz = F.when((F.col("bscan_rate_hz") > 0) & (F.col("y_line_count") > 0),
                F.col("bscan_rate_hz") / F.col("y_line_count")).otherwise(F.lit(0.0))
    points = F.col("records_per_buffer").cast("double") * F.col("y_line_count")
    return (
        joined.withColumn("frame_rate_hz", hz)
        .withColumn("frame_time_ms", F.when(F.col("frame_rate_hz") > 0, F.lit(1000.0) / F.col("frame_rate_hz")).otherwise(F.lit(0.0)))
        .withColumn("waveform_frame_time_ms", F.when(
            F.col("scanner_sample_rate_hz") > 0, points * 1000.0 / F.col("scanner_sample_rate_hz")).otherwise(F.lit(0.0)))
        .withColumn("record_period_s", F.when(
            F.col("sample_rate_hz") > 0, F.col("sample_point") / F.col("sample_rate_hz")).otherwise(F.lit(0.0))))


def sequence_gaps(deliveries: DataFrame, *, every_s: int = 5, span: int = 1 << 17) -> DataFrame:
    """Per session and interval: source advance, largest step, sequences not delivered, source and delivery Hz.

    Rows: session_id, delivery (ordinal), ts_s (seconds), sequence.
    """
    stepped = previous(deliveries, Series(("session_id",), ("delivery",), span), {"_before": "sequence"})
    step = F.when(F.col("sequence") > F.col("_before"), F.col("sequence") - F.col("_before")).otherwise(F.lit(0))
    grouped = stepped.withColumn("_step", step).groupBy(
        "session_id", (F.floor(F.col("ts_s") / every_s) * every_s).cast("long").alias("interval_start_s")
    ).agg(
        F.sum("_step").cast("long").alias("source_advance"), F.max("_step").cast("long").alias("maximum_step"),
        F.sum(F.greatest(F.col("_step") - 1, F.lit(0))).cast("long").alias("not_delivered"),
        F.count(F.lit(1)).alias("deliveries"))
    return grouped.withColumn("source_hz", F.col("source_advance") / F.lit(float(every_s))).withColumn(
        "delivery_hz", F.col("deliveries") / F.lit(float(every_s)))


def throughput(writes: DataFrame) -> DataFrame:
    """Megabits per second and items per second since each session's start. Rows: session_id, ts_s, bytes."""
    totals = writes.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("writes"), F.sum("bytes").cast("long").alias("bytes"),
        (F.max("ts_s") - F.min("ts_s")).cast("double").alias("elapsed_s"))
    moving = F.col("elapsed_s") > 0
    return (
        totals.withColumn("megabits_per_s", F.when(moving, F.col("bytes") * 8.0e-6 / F.col("elapsed_s")).otherwise(F.lit(0.0)))
        .withColumn("items_per_s", F.when(moving, F.col("writes") / F.col("elapsed_s")).otherwise(F.lit(0.0))))


def counter_deltas(batches: DataFrame, *, span: int = 1 << 17) -> DataFrame:
    """Cumulative drop and missed-trigger counters to per-buffer increments; a restart counts from zero."""
    names = ("dropped_buffer_count", "missed_trigger_count")
    stepped = previous(batches, Series(("session_id",), ("sequence",), span), {f"_p_{n}": n for n in names})
    return stepped.select(
        *batches.columns,
        *[
            F.when(F.col(f"_p_{n}").isNull() | (F.col(n) < F.col(f"_p_{n}")), F.col(n))
            .otherwise(F.col(n) - F.col(f"_p_{n}")).alias(n.replace("_count", "_delta"))
            for n in names
        ])


def expected_data_rate(config: DataFrame) -> DataFrame:
    """Raw megabytes per second of a profile; above 1000 with raw storage on is a warning."""
    rate = F.when((F.col("sample_rate_hz") > 0) & (F.col("sample_point") > 0),
                  F.lit(2.0) * F.col("sample_rate_hz") / 1.0e6).otherwise(F.lit(0.0))
    return config.withColumn("megabytes_per_s", rate).withColumn(
        "rate_warning", F.coalesce(F.col("raw_enabled") & (F.col("megabytes_per_s") > 1000.0), F.lit(False)))


def accounting(delivered: DataFrame, measured: DataFrame, points: DataFrame) -> DataFrame:
    """Whether every delivered record was measured and became a valid point, with nothing lost or late.

    ``delivered``: session_id, records, batches, dropped, rejected, deadline_misses.
    ``measured``: session_id, measured_records. ``points``: session_id, valid_points.
    """
    joined = delivered.join(measured, "session_id", "full_outer").join(points, "session_id", "full_outer")
    numbers = ("records", "batches", "dropped", "rejected", "deadline_misses", "measured_records", "valid_points")
    filled = joined.select("session_id", *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in numbers])
    exact = (F.col("records") == F.col("measured_records")) & (F.col("records") == F.col("valid_points"))
    functional = exact & (F.col("batches") > 0)
    clean = (F.col("dropped") == 0) & (F.col("rejected") == 0) & (F.col("deadline_misses") == 0)
    return filled.withColumn("functional", functional).withColumn("hard_pass", functional & clean)


def session_health(**parts: DataFrame) -> DataFrame:
    """One row per session with every part's counters side by side, prefixed by the part's name."""
    health = None
    for name, part in parts.items():
        renamed = part.select("session_id", *[F.col(c).alias(f"{name}_{c}") for c in part.columns if c != "session_id"])
        health = renamed if health is None else health.join(renamed, "session_id", "full_outer")
    return health
