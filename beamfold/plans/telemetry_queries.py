"""Queries of sections I and K: telemetry and plot reductions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beamfold.operators import plots as K, raster, telemetry as I
from beamfold.plans.catalog import query, r6, sql6, with_ctes
from beamfold.plans.geometry_queries import FRAME_CELLS, FULL_LINES, filled, located, sqlf
from beamfold.plans.tables import BATCHES, CELLS, HEIGHT, STAGE_SQL, WIDTH, batches, cells, config, epoch_us, table

SPAN = 2000
STAGES = tuple(I.STAGES)


@query("I1_stage_latency", with_ctes(BATCHES, STAGE_SQL, select=f"""
SELECT session_id, sequence, {', '.join(sql6(n, n) for n in STAGES)} FROM latency"""))
def i1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.stage_latency(batches(spark, sf_dir)).withColumns({n: r6(n) for n in STAGES})


@query("I2_latency_summary", with_ctes(BATCHES, STAGE_SQL, select=f"""
SELECT session_id, count(*) AS batches, {', '.join(
    f"{sql6(f'arg_max({n}, sequence)', f'last_{n}')}, {sql6(f'avg({n}) * count(*)', f'total_{n}')}, {sql6(f'max({n})', f'max_{n}')}"
    for n in STAGES)},
  {', '.join(f"arg_min(sequence, (-{n}, sequence)) AS max_{n}_sequence" for n in ('end_to_end_ms', 'acquisition_wakeup_ms', 'compute_ms'))}
FROM latency GROUP BY session_id"""))
def i2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.latency_summary(I.stage_latency(batches(spark, sf_dir)))
    # Means are compared as totals, which are exact at six decimals.
    out = out.withColumns({f"total_{n}": F.col(f"mean_{n}") * F.col("batches") for n in STAGES})
    out = out.drop(*[f"mean_{n}" for n in STAGES])
    return out.withColumns({c: r6(c) for c in out.columns if c.endswith("_ms")})


@query("I3_rolling_percentiles", with_ctes(BATCHES, STAGE_SQL, """recent AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sequence DESC) AS back FROM latency) WHERE back <= 40)""",
    select=f"""
SELECT session_id, CAST(count(*) AS INTEGER) AS window_batches,
  {', '.join(sql6(f"list_sort(list(end_to_end_ms))[CAST(greatest(ceil({q}e0 * count(*)), 1) AS INTEGER)]", f"p{p}_ms")
             for q, p in ((0.5, 50), (0.95, 95), (0.99, 99)))}
FROM recent GROUP BY session_id"""))
def i3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.rolling_percentiles(I.stage_latency(batches(spark, sf_dir)), n=40, span=SPAN)
    return out.withColumns({c: r6(c) for c in out.columns if c.endswith("_ms")})


@query("I4_deadline_misses", with_ctes(BATCHES, STAGE_SQL, select="""
SELECT session_id, count(*) AS batches, count(*) FILTER (end_to_end_ms > 5e0) AS deadline_misses FROM latency GROUP BY session_id"""))
def i4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.deadline_misses(I.stage_latency(batches(spark, sf_dir)))


@query("I5_period_ema", with_ctes(BATCHES, """steps AS (
  SELECT session_id, sequence, wakeup_ns, lag(wakeup_ns) OVER (PARTITION BY session_id ORDER BY sequence) AS before FROM batches),
periods AS (SELECT session_id, sequence, CASE WHEN before <> 0 AND wakeup_ns > before THEN (wakeup_ns - before) * 1e-6 END AS period_ms FROM steps),
histories AS (
  SELECT *, list_filter(list(period_ms) OVER (PARTITION BY session_id ORDER BY sequence), lambda p: p IS NOT NULL) AS seen FROM periods),
averages AS (
  SELECT session_id, sequence, period_ms,
         CASE WHEN len(seen) > 0 THEN list_reduce(seen, lambda a, p: 0.2e0 * p + (1e0 - 0.2e0) * a) END AS ema FROM histories)""",
    select=f"""
SELECT session_id, sequence, {sqlf("period_ms", "period_ms")}, {sqlf("ema", "period_ema_ms")}, {sqlf("1000e0 / ema", "rate_hz")} FROM averages"""))
def i5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.period_ema(batches(spark, sf_dir), span=SPAN)
    return out.withColumns({c: filled(c) for c in ("period_ms", "period_ema_ms", "rate_hz")})


@query("I6_frame_rate", f"""
SELECT o_orderkey, {sql6("CASE WHEN o_custkey % 7 > 0 THEN (o_custkey % 7) * 31e0 / 5 ELSE 0 END", "frame_rate_hz")},
       {sql6("CASE WHEN o_custkey % 7 > 0 THEN 1000e0 / ((o_custkey % 7) * 31e0 / 5) ELSE 0 END", "frame_time_ms")},
       {sql6("10 * 5 * 1000e0 / 1e5", "waveform_frame_time_ms")}, {sql6("64 / 1e7", "record_period_s")}
FROM orders""")
def i6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 5).alias("config_revision"),
        ((F.col("o_custkey") % 7) * 31.0).alias("bscan_rate_hz"))
    names = ("frame_rate_hz", "frame_time_ms", "waveform_frame_time_ms", "record_period_s")
    return I.frame_rate(rates, config(spark, sf_dir)).select("o_orderkey", *[r6(n).alias(n) for n in names])


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.select(
        F.concat(F.lit("u"), (F.col("user_id") % 4).cast("string")).alias("session_id"), F.col("event_id").alias("delivery"),
        F.floor(epoch_us(df, "ts") / 1000000).cast("long").alias("ts_s"),
        (F.col("event_id") * 3 - F.col("event_id") % 11 * 2).alias("sequence"))


@query("I7_sequence_gaps", f"""
WITH d AS (SELECT 'u' || (user_id % 4) AS session_id, event_id AS delivery, epoch_us(ts) // 1000000 AS ts_s,
                  event_id * 3 - event_id % 11 * 2 AS sequence FROM events),
s AS (SELECT *, CASE WHEN sequence > lag(sequence) OVER w THEN sequence - lag(sequence) OVER w ELSE 0 END AS step FROM d
      WINDOW w AS (PARTITION BY session_id ORDER BY delivery))
SELECT session_id, ts_s // 86400 * 86400 AS interval_start_s, CAST(sum(step) AS BIGINT) AS source_advance, max(step) AS maximum_step,
       CAST(sum(greatest(step - 1, 0)) AS BIGINT) AS not_delivered, count(*) AS deliveries,
       {sql6("sum(step) / 86400e0", "source_hz")}, {sql6("count(*) / 86400e0", "delivery_hz")}
FROM s GROUP BY ALL""")
def i7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.sequence_gaps(deliveries(spark, sf_dir), every_s=86400, span=SPAN)
    return out.withColumns({c: r6(c) for c in ("source_hz", "delivery_hz")})


@query("I8_throughput", f"""
SELECT session_id, count(*) AS writes, CAST(sum(bytes) AS BIGINT) AS bytes, {sql6("max(ts_s) - min(ts_s)", "elapsed_s")},
       {sql6("CASE WHEN max(ts_s) > min(ts_s) THEN sum(bytes) * 8e-6 / (max(ts_s) - min(ts_s)) ELSE 0 END", "megabits_per_s")},
       {sql6("CASE WHEN max(ts_s) > min(ts_s) THEN count(*) / (max(ts_s) - min(ts_s)) ELSE 0 END", "items_per_s")}
FROM (SELECT 'u' || user_id AS session_id, epoch_us(ts) // 1000000 AS ts_s, CAST(round(value * 1e5) AS BIGINT) AS bytes FROM events)
GROUP BY session_id""")
def i8(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    writes = df.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"),
        F.floor(epoch_us(df, "ts") / 1000000).cast("long").alias("ts_s"),
        F.round(F.col("value") * 1e5).cast("long").alias("bytes"))
    return I.throughput(writes).withColumns({c: r6(c) for c in ("elapsed_s", "megabits_per_s", "items_per_s")})


@query("I9_counter_deltas", with_ctes(BATCHES, select="""
SELECT session_id, sequence, dropped_buffer_count - coalesce(lag(dropped_buffer_count) OVER w, 0) AS dropped_buffer_delta,
       missed_trigger_count - coalesce(lag(missed_trigger_count) OVER w, 0) AS missed_trigger_delta
FROM batches WINDOW w AS (PARTITION BY session_id ORDER BY sequence)"""))
def i9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.counter_deltas(batches(spark, sf_dir), span=SPAN).select(
        "session_id", "sequence", "dropped_buffer_delta", "missed_trigger_delta")


@query("I10_expected_data_rate", f"""
SELECT p_partkey, {sql6("CASE WHEN p_size > 0 THEN 2e0 * (p_retailprice * 4e5) / 1e6 ELSE 0 END", "megabytes_per_s")},
       p_partkey % 3 <> 0 AND 2e0 * (p_retailprice * 4e5) / 1e6 > 1000 AS rate_warning FROM part""")
def i10(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = table(spark, sf_dir, "part").select(
        "p_partkey", (F.col("p_retailprice") * 4e5).alias("sample_rate_hz"), F.col("p_size").alias("sample_point"),
        (F.col("p_partkey") % 3 != 0).alias("raw_enabled"))
    return I.expected_data_rate(profiles).select("p_partkey", r6("megabytes_per_s").alias("megabytes_per_s"), "rate_warning")


def account_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")

    def session(key: str) -> Column:
        return F.concat(F.lit("c"), (F.col(key) % 400).cast("string")).alias("session_id")

    delivered = orders.groupBy(session("o_orderkey")).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct("o_custkey").alias("batches"),
        F.count_if(F.col("o_totalprice") > 495000).alias("dropped"), F.lit(0).cast("long").alias("rejected"),
        F.count_if(F.col("o_totalprice") < 2000).alias("deadline_misses"))
    measured = lines.groupBy(session("l_orderkey")).agg(F.count_distinct("l_orderkey").alias("measured_records"))
    valid = lines.where("l_quantity > 1").groupBy(session("l_orderkey")).agg(
        F.count_distinct("l_orderkey").alias("valid_points"))
    return delivered, measured, valid


ACCOUNT = """delivered AS (
  SELECT 'c' || (o_orderkey % 400) AS session_id, count(*) AS records, count(DISTINCT o_custkey) AS batches,
         count(*) FILTER (o_totalprice > 495000) AS dropped, count(*) FILTER (o_totalprice < 2000) AS deadline_misses
  FROM orders GROUP BY 1),
measured AS (SELECT 'c' || (l_orderkey % 400) AS session_id, count(DISTINCT l_orderkey) AS measured_records FROM lineitem GROUP BY 1),
valid AS (SELECT 'c' || (l_orderkey % 400) AS session_id, count(DISTINCT l_orderkey) AS valid_points FROM lineitem WHERE l_quantity > 1 GROUP BY 1),
accounts AS (
  SELECT session_id, coalesce(records, 0) AS records, coalesce(batches, 0) AS batches, coalesce(dropped, 0) AS dropped,
         CAST(0 AS BIGINT) AS rejected, coalesce(deadline_misses, 0) AS deadline_misses,
         coalesce(measured_records, 0) AS measured_records, coalesce(valid_points, 0) AS valid_points
  FROM delivered FULL JOIN measured USING (session_id) FULL JOIN valid USING (session_id))"""


@query("I11_accounting", with_ctes(ACCOUNT, select="""
SELECT *, records = measured_records AND records = valid_points AND batches > 0 AS functional,
       records = measured_records AND records = valid_points AND batches > 0 AND dropped = 0 AND rejected = 0
         AND deadline_misses = 0 AS hard_pass FROM accounts"""))
def i11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.accounting(*account_parts(spark, sf_dir))


@query("I12_session_health", with_ctes(BATCHES, STAGE_SQL, select=f"""
SELECT l.session_id, l.batches AS deadline_batches, l.misses AS deadline_deadline_misses, t.drops AS counters_drops,
       t.triggers AS counters_triggers, {sql6("l.total_ms", "latency_total_ms")}, {sql6("l.max_ms", "latency_max_ms")}
FROM (SELECT session_id, count(*) AS batches, count(*) FILTER (end_to_end_ms > 5) AS misses, sum(end_to_end_ms) AS total_ms,
             max(end_to_end_ms) AS max_ms FROM latency GROUP BY 1) l
FULL JOIN (SELECT session_id, max(dropped_buffer_count) AS drops, max(missed_trigger_count) AS triggers FROM batches GROUP BY 1) t
USING (session_id)"""))
def i12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batches(spark, sf_dir)
    latency = I.stage_latency(rows)
    summary = I.latency_summary(latency).select(
        "session_id", r6(F.col("mean_end_to_end_ms") * F.col("batches")).alias("total_ms"), r6("max_end_to_end_ms").alias("max_ms"))
    counters = rows.groupBy("session_id").agg(
        F.max("dropped_buffer_count").alias("drops"), F.max("missed_trigger_count").alias("triggers"))
    return I.session_health(deadline=I.deadline_misses(latency), counters=counters, latency=summary)


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` values as series of 2000, with gaps at refunds and errors."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.floor(e / 2000).alias("series_id"), (e % 2000).alias("idx"),
        F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))


SERIES = """series AS (SELECT event_id // 2000 AS series_id, event_id % 2000 AS idx,
  CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"""


@query("K1_envelope", with_ctes(SERIES, select=f"""
SELECT series_id, ((idx + 1) * least(300, n) - 1) // n AS bucket, {sql6("min(value)", "low")}, {sql6("max(value)", "high")}
FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM series) WHERE value IS NOT NULL GROUP BY ALL"""))
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.envelope(user_series(spark, sf_dir), 300)
    return out.select("series_id", "bucket", r6("low").alias("low"), r6("high").alias("high"))


@query("K2_finite_runs", with_ctes(SERIES, select="""
SELECT series_id, run, min(idx) AS first_idx, max(idx) AS last_idx, count(*) AS length FROM (
  SELECT *, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY idx) AS BIGINT) AS run FROM series)
WHERE value IS NOT NULL GROUP BY series_id, run"""))
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.finite_runs(user_series(spark, sf_dir), span=300)


@query("K3_series_range", with_ctes(SERIES, select=f"""
SELECT plot_id, {sql6("min(lo)", "minimum")}, {sql6("max(hi)", "maximum")}, max(n) AS longest, bool_or(gap) AS contains_gap FROM (
  SELECT series_id % 3 AS plot_id, series_id, min(value) AS lo, max(value) AS hi, count(*) AS n, bool_or(value IS NULL) AS gap
  FROM series GROUP BY ALL) GROUP BY plot_id"""))
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.series_range(user_series(spark, sf_dir).withColumn("plot_id", F.col("series_id") % 3))
    return out.withColumns({c: r6(c) for c in ("minimum", "maximum")})


def heatmap(spark: SparkSession, sf_dir: str, **limits: float) -> DataFrame:
    frames = K.heatmap_normalise(raster.assemble_bscan(located(spark, sf_dir), WIDTH, HEIGHT), **limits)
    rows = frames.select(*raster.FRAME_KEYS, F.posexplode("normalised").alias("cell", "v"))
    return rows.select(*raster.FRAME_KEYS, "cell", filled("v").alias("normalised"))


@query("K4_heatmap_normalise", with_ctes(CELLS, FULL_LINES, FRAME_CELLS, """ranges AS (
  SELECT *, coalesce(min(px) OVER f, 0e0) AS lo, coalesce(max(px) OVER f, 1e0) AS hi FROM frame_cells
  WINDOW f AS (PARTITION BY session_id, scan_frame_index))""", select=f"""
SELECT session_id, scan_frame_index, CAST(y_index * 10 + x_index AS INTEGER) AS cell,
       {sqlf("(px - lo) / CASE WHEN abs(hi - lo) < 1e-6 THEN 1e0 ELSE hi - lo END", "normalised")} FROM ranges"""))
def k4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heatmap(spark, sf_dir)


@query("K4_heatmap_manual_range", with_ctes(CELLS, FULL_LINES, FRAME_CELLS, select=f"""
SELECT session_id, scan_frame_index, CAST(y_index * 10 + x_index AS INTEGER) AS cell, {sqlf("(px - 3e0) / 0.7e0", "normalised")}
FROM frame_cells"""))
def k4_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heatmap(spark, sf_dir, lo=3.0, hi=3.7)


@query("K5_mask_invalid", with_ctes(CELLS, select=f"""
SELECT session_id, frame_id, {sqlf("CASE WHEN both_ok THEN o_totalprice / 299792.458e0 END", "distance_m")},
       {sqlf("CASE WHEN both_ok THEN (o_custkey % 100 - 50) / 10e0 END", "velocity_mps")} FROM cells"""))
def k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = K.mask_invalid(cells(spark, sf_dir), ["distance_m", "velocity_mps"])
    return masked.select("session_id", "frame_id", filled("distance_m").alias("distance_m"), filled("velocity_mps").alias("velocity_mps"))


@query("K7_nearest_rank_percentile", f"""
SELECT l_returnflag, CAST(100 * q AS INTEGER) AS q, count(*) AS n,
       {sql6("list_sort(list(l_extendedprice))[CAST(greatest(ceil(q * count(*)), 1) AS INTEGER)]", "percentile")}
FROM lineitem, (VALUES (0e0), (0.5e0), (0.95e0), (1e0)) AS v(q) GROUP BY l_returnflag, q""")
def k7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = K.nearest_rank_percentile(table(spark, sf_dir, "lineitem"), "l_extendedprice", (0.0, 0.5, 0.95, 1.0), keys=["l_returnflag"])
    return out.select("l_returnflag", F.round(F.col("q") * 100).cast("int").alias("q"), "n", r6("percentile").alias("percentile"))
