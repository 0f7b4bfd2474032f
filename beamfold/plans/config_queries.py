"""Queries of section J and the setup, gate and match operators of section A."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from beamfold.functions.signal import setpoint_dbm
from beamfold.operators import configuration as J
from beamfold.plans.catalog import query, r6, sql6, with_ctes
from beamfold.plans.tables import cells, table
from beamfold.schemas import STANDARD_COORDINATE_FRAME
from beamfold.sources import recordings as A, sessions as AS

LAYERS = ("default", "base", "platform", "profile", "calibration")
# (path, Spark value, SQL value): what each customer's layers set; some values are deliberately wrong.
OVERRIDES = {
    "digitizer.board_profile": (
        lambda k: F.element_at(F.array(*[F.lit(b) for b in ("ats9371", "ats9350", "ats9999", "ats9373")]), (k % 4 + 1).cast("int")),
        "(['ats9371', 'ats9350', 'ats9999', 'ats9373'])[k % 4 + 1]"),
    "digitizer.sample_rate_hz": (
        lambda k: F.element_at(F.array(*[F.lit(b) for b in ("1000000000", "500000000", "fast", "123456789")]), (k % 9 % 4 + 1).cast("int")),
        "(['1000000000', '500000000', 'fast', '123456789'])[k % 9 % 4 + 1]"),
    "digitizer.sample_point": (lambda k: (F.lit(4096) + k % 3 * 64).cast("string"), "CAST(4096 + k % 3 * 64 AS VARCHAR)"),
    "digitizer.impedance_ohms": (lambda k: F.when(k % 11 == 0, "75").otherwise("50"), "CASE WHEN k % 11 = 0 THEN '75' ELSE '50' END"),
    "udp.enabled": (lambda k: F.when(k % 5 == 0, "true").otherwise("false"), "CASE WHEN k % 5 = 0 THEN 'true' ELSE 'false' END"),
    "udp.target_ip": (lambda k: F.concat(F.lit("10.0.0."), (k % 400).cast("string")), "'10.0.0.' || (k % 400)"),
    "chirp_segmentation.segment_fft_length": (lambda k: (F.lit(1500) + k % 7 * 274).cast("string"), "CAST(1500 + k % 7 * 274 AS VARCHAR)"),
    "chirp_segmentation.window": (lambda k: F.when(k % 13 == 0, "kaiser").otherwise("hann"), "CASE WHEN k % 13 = 0 THEN 'kaiser' ELSE 'hann' END"),
    "processing.queue_capacity": (lambda k: (k % 17).cast("string"), "CAST(k % 17 AS VARCHAR)"),
    "storage.raw_enabled": (lambda k: F.when(k % 2 == 0, "true").otherwise("false"), "CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END"),
    "scan.trigger_shift_samples": (lambda k: (k * 37 % 40000 - 20000).cast("string"), "CAST(k * 37 % 40000 - 20000 AS VARCHAR)"),
    "mcu.enabled": (lambda k: F.when(k % 3 == 0, "true").otherwise("false"), "CASE WHEN k % 3 = 0 THEN 'true' ELSE 'false' END"),
    "mcu.retry_count": (lambda k: (k % 6 - 1).cast("string"), "CAST(k % 6 - 1 AS VARCHAR)"),
}


def layers(spark: SparkSession, sf_dir: str, *, with_unknown: bool = False) -> DataFrame:
    """Up to two layers per customer and path: the nation decides which layers set which path."""
    k = F.col("c_custkey")
    rows = [
        F.struct(F.lit(path).alias("path"), value(k + step).alias("value"), F.lit(step).alias("step"), F.lit(i).alias("i"))
        for i, (path, (value, _)) in enumerate(OVERRIDES.items()) for step in (0, 1)
    ]
    customers = table(spark, sf_dir, "customer")
    flat = customers.select("c_custkey", "c_nationkey", F.explode(F.array(*rows)).alias("r"))
    flat = flat.where((F.col("c_nationkey") + F.col("r.i") + F.col("r.step")) % 3 != 0)
    priority = F.when(F.col("r.step") == 0, F.col("r.i") % 2 + 1).otherwise(F.col("r.i") % 2 + 3)
    out = flat.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("session_id"),
        F.element_at(F.array(*[F.lit(n) for n in LAYERS]), (priority + 1).cast("int")).alias("layer"),
        priority.alias("priority"), F.col("r.path").alias("path"), F.col("r.value").alias("value"))
    if with_unknown:
        odd = customers.where(k % 10 == 3).select(
            F.concat(F.lit("c"), k.cast("string")).alias("session_id"), F.lit("base").alias("layer"),
            F.lit(1).alias("priority"), F.lit("digitizer.turbo").alias("path"), F.lit("on").alias("value"))
        out = out.unionByName(odd)
    return out


def _layer_select(i: int, path: str, value: str, step: int) -> str:
    priority = i % 2 + (1 if step == 0 else 3)
    return (f"SELECT 'c' || c_custkey AS session_id, '{LAYERS[priority]}' AS layer, {priority} AS priority, '{path}' AS path, "
            f"(SELECT {value} FROM (SELECT c_custkey + {step} AS k)) AS value FROM customer WHERE (c_nationkey + {i} + {step}) % 3 <> 0")


LAYER_SQL = "layers AS (" + "\nUNION ALL ".join(
    _layer_select(i, path, value, step) for i, (path, (_, value)) in enumerate(OVERRIDES.items()) for step in (0, 1)) + ")"
RESOLVED = "resolved AS (SELECT session_id, path, arg_max(value, priority) AS value, arg_max(layer, priority) AS layer FROM layers GROUP BY ALL)"


@query("J1_resolve_config", with_ctes(LAYER_SQL, RESOLVED, select="SELECT * FROM resolved"))
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.resolve_config(layers(spark, sf_dir))


@query("J2_unknown_keys", "SELECT 'c' || c_custkey AS session_id, 'base' AS layer, 'digitizer.turbo' AS path FROM customer WHERE c_custkey % 10 = 3")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.unknown_keys(layers(spark, sf_dir, with_unknown=True), J.schema_table(spark))


@query("J2_mergeable_layers", with_ctes(LAYER_SQL, select="""
SELECT session_id, layer, path, value FROM layers WHERE CAST(substr(session_id, 2) AS BIGINT) % 10 <> 3"""))
def j2_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = J.mergeable(layers(spark, sf_dir, with_unknown=True), J.schema_table(spark))
    return merged.select("session_id", "layer", "path", "value")


WIDE = "wide AS (SELECT session_id, " + ", ".join(
    f"max(value) FILTER (path = '{path}') AS v{i}" for i, path in enumerate(OVERRIDES)) + " FROM resolved GROUP BY session_id)"
N = {path: f"v{i}" for i, path in enumerate(OVERRIDES)}
TYPED = f"""typed AS (
  SELECT session_id, coalesce({N['digitizer.board_profile']}, 'ats9371') AS board,
    TRY_CAST(coalesce({N['digitizer.sample_rate_hz']}, '1000000000') AS DOUBLE) AS rate,
    TRY_CAST(coalesce({N['digitizer.sample_point']}, '4096') AS BIGINT) AS points,
    TRY_CAST(coalesce({N['digitizer.impedance_ohms']}, '50') AS BIGINT) AS ohms,
    coalesce({N['udp.enabled']}, 'false') = 'true' AS udp, coalesce({N['udp.target_ip']}, '192.168.0.10') AS ip,
    TRY_CAST(coalesce({N['chirp_segmentation.segment_fft_length']}, '2048') AS BIGINT) AS fft,
    CASE WHEN coalesce({N['chirp_segmentation.window']}, 'hann') = 'hann' THEN 'hann' END AS win,
    TRY_CAST(coalesce({N['processing.queue_capacity']}, '32') AS BIGINT) AS queue,
    coalesce({N['storage.raw_enabled']}, 'false') = 'true' AS raw,
    TRY_CAST(coalesce({N['scan.trigger_shift_samples']}, '0') AS BIGINT) AS shift,
    coalesce({N['mcu.enabled']}, 'false') = 'true' AS mcu,
    CASE WHEN TRY_CAST(coalesce({N['mcu.retry_count']}, '2') AS BIGINT) >= 0 THEN TRY_CAST(coalesce({N['mcu.retry_count']}, '2') AS BIGINT) END AS retries
  FROM wide)"""
CONFIG_CTES = (LAYER_SQL, RESOLVED, WIDE, TYPED)


def typed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return J.typed_config(J.resolve_config(layers(spark, sf_dir)))


@query("J3_typed_config", with_ctes(*CONFIG_CTES, select=f"""
SELECT session_id, board, {sql6("coalesce(rate, -1)", "rate")}, points, ohms, udp, ip, fft, coalesce(win, 'none') AS win, queue, raw, shift, mcu,
       coalesce(retries, -1) AS retries, 'fftw' AS backend, {sql6("2e9", "bandwidth")} FROM typed"""))
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    config, _ = typed(spark, sf_dir)

    def c(path: str) -> Column:
        return F.col(f"`{path}`")

    return config.select(
        "session_id", c("digitizer.board_profile").alias("board"), r6(F.coalesce(c("digitizer.sample_rate_hz"), F.lit(-1.0))).alias("rate"),
        c("digitizer.sample_point").alias("points"), c("digitizer.impedance_ohms").alias("ohms"), c("udp.enabled").alias("udp"),
        c("udp.target_ip").alias("ip"), c("chirp_segmentation.segment_fft_length").alias("fft"),
        F.coalesce(c("chirp_segmentation.window"), F.lit("none")).alias("win"), c("processing.queue_capacity").alias("queue"),
        c("storage.raw_enabled").alias("raw"), c("scan.trigger_shift_samples").alias("shift"), c("mcu.enabled").alias("mcu"),
        F.coalesce(c("mcu.retry_count"), F.lit(-1)).alias("retries"), c("processing.fft_backend").alias("backend"),
        r6(c("laser.sweep_bandwidth_hz")).alias("bandwidth"))


@query("J3_config_issues", with_ctes(*CONFIG_CTES, select="""
SELECT session_id, 'digitizer.sample_rate_hz' AS path, 'type' AS issue FROM typed WHERE rate IS NULL UNION ALL
SELECT session_id, 'chirp_segmentation.window', 'enum' FROM typed WHERE win IS NULL UNION ALL
SELECT session_id, 'mcu.retry_count', 'range' FROM typed WHERE retries IS NULL"""))
def j3_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir)[1]


BOARD_SQL = "boards(id, rates, step) AS (VALUES " + ", ".join(
    f"('{b[0]}', [{', '.join(repr(r) for r in b[1])}], {b[4]})" for b in J.BOARDS) + ")"
CHECKED = """checked AS (
  SELECT t.*, b.id IS NOT NULL AS known, CASE WHEN rate IS NOT NULL THEN len(list_filter(b.rates, lambda r: abs(rate - r) <= greatest(1e0, abs(r) * 1e-9))) > 0 END AS rate_ok,
         points >= 256 AND points % b.step = 0 AS record_ok FROM typed t LEFT JOIN boards b ON t.board = b.id)"""


@query("J4_validate_config", with_ctes(*CONFIG_CTES, BOARD_SQL, CHECKED, select="""
SELECT session_id, severity, path, count(*) AS findings FROM (
  SELECT session_id, 'error' AS severity, 'digitizer.board_profile' AS path FROM checked WHERE NOT known UNION ALL
  SELECT session_id, 'error', 'digitizer.sample_rate_hz' FROM checked WHERE known AND NOT rate_ok UNION ALL
  SELECT session_id, 'error', 'digitizer.sample_point' FROM checked WHERE known AND NOT record_ok UNION ALL
  SELECT session_id, 'error', 'digitizer.sample_point' FROM checked WHERE points <> 4096 UNION ALL
  SELECT session_id, 'error', 'digitizer.input_range_volts' FROM checked WHERE known AND ohms <> 50 UNION ALL
  SELECT session_id, 'error', 'digitizer.input_range_volts' FROM checked WHERE ohms NOT IN (50, 1000000) UNION ALL
  SELECT session_id, 'error', 'chirp_segmentation.segment_fft_length' FROM checked WHERE fft < 1728 UNION ALL
  SELECT session_id, 'warning', 'chirp_segmentation.segment_fft_length' FROM checked WHERE fft >= 1728 AND bit_count(fft) <> 1 UNION ALL
  SELECT session_id, 'error', 'processing.peak_search_end_bin' FROM checked WHERE 900 >= fft // 2 UNION ALL
  SELECT session_id, 'error', 'processing.queue_capacity' FROM checked WHERE queue = 0 UNION ALL
  SELECT session_id, 'error', 'scan.trigger_shift_samples' FROM checked WHERE mcu AND abs(shift) >= 15000 UNION ALL
  SELECT session_id, 'error', 'udp' FROM checked WHERE udp AND CAST(split_part(ip, '.', 4) AS INTEGER) > 255 UNION ALL
  SELECT session_id, 'error', 'mcu.port' FROM checked WHERE mcu UNION ALL
  SELECT session_id, 'warning', 'storage.raw_enabled' FROM checked WHERE raw AND 2 * rate / 1e6 > 1000)
GROUP BY ALL"""))
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.validate_config(typed(spark, sf_dir)[0], J.boards(spark))
    return found.groupBy("session_id", "severity", "path").agg(F.count(F.lit(1)).alias("findings"))


@query("J5_board_capability_check", with_ctes(*CONFIG_CTES, BOARD_SQL, CHECKED, select="""
SELECT session_id, known AS board_known, coalesce(rate_ok, false) AND known AS rate_ok, coalesce(record_ok, false) AS record_ok,
  known AS input_ok, coalesce(ohms = 50, false) AND known AS impedance_ok, known AS pretrigger_ok, known AS delay_ok FROM checked"""))
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = J.board_capability_check(typed(spark, sf_dir)[0], J.boards(spark))
    return out.select("session_id", "board_known", *[F.coalesce(n, F.lit(False)).alias(n) 
        for n in ("rate_ok", "record_ok", "input_ok", "impedance_ok", "pretrigger_ok", "delay_ok")])


@query("J6_nearest_record_length", """
SELECT p_partkey, CASE WHEN r <= floor_length THEN floor_length ELSE greatest(floor_length,
         CASE WHEN r - r // s * s < s - (r - r // s * s) THEN r // s * s ELSE r // s * s + s END) END AS length
FROM (SELECT p_partkey, p_partkey * 13 % 9000 AS r, CASE WHEN p_size % 2 = 0 THEN 128 ELSE 32 END AS s,
             CAST(CASE WHEN p_size % 2 = 0 THEN (250 + 127) // 128 * 128 ELSE (250 + 31) // 32 * 32 END AS BIGINT) AS floor_length FROM part)""")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.when(F.col("p_size") % 2 == 0, 128).otherwise(32)
    length = J.nearest_record_length(F.col("p_partkey") * 13 % 9000, F.lit(250), step)
    return table(spark, sf_dir, "part").select("p_partkey", length.alias("length"))


@query("J7_diff_config", with_ctes(LAYER_SQL, """a AS (SELECT * FROM layers WHERE priority <= 2), b AS (SELECT * FROM layers WHERE priority >= 3)""", select="""
SELECT session_id, path, coalesce(a.value, 'absent') AS old_value, coalesce(b.value, 'absent') AS new_value
FROM a FULL JOIN b USING (session_id, path) WHERE a.value IS DISTINCT FROM b.value"""))
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layers(spark, sf_dir)
    out = J.diff_config(rows.where("priority <= 2"), rows.where("priority >= 3"))
    return out.withColumns({n: F.coalesce(n, F.lit("absent")) for n in ("old_value", "new_value")})


@query("J9_stamp_processing_revision", """
WITH r AS (
  SELECT 's' || (o_orderkey // 5000) AS session_id, o_orderkey % 5000 + 1 AS frame_id, (o_orderkey % 5000) * 1000 AS ts,
         o_orderkey % 211 = 0 OR ((o_orderkey % 5000) // 10) % 5 = 0 AS starts FROM orders),
u AS (SELECT 's' || (o_orderkey // 5000) AS session_id, (o_orderkey % 5000) * 1000 + 500 AS ts, o_custkey AS revision
      FROM orders WHERE o_orderkey % 333 = 7),
merged AS (SELECT session_id, ts, 1 AS side, frame_id, starts, NULL AS rev FROM r UNION ALL SELECT session_id, ts, 0, 0, false, revision FROM u),
pending AS (SELECT *, last_value(rev IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, side) AS p FROM merged)
SELECT session_id, frame_id, coalesce(rev, -1) AS processing_revision FROM (
  SELECT session_id, frame_id, side, last_value(CASE WHEN starts THEN p END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY ts, side) AS rev
  FROM pending) WHERE side = 1""")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.col("o_orderkey") % 5000
    updates = table(spark, sf_dir, "orders").where(F.col("o_orderkey") % 333 == 7).select(
        F.concat(F.lit("s"), F.floor(F.col("o_orderkey") / 5000).cast("string")).alias("session_id"),
        (place * 1000 + 500).alias("requested_ns"), F.col("o_custkey").alias("revision"))
    stamped = J.stamp_processing_revision(cells(spark, sf_dir), updates, span_ns=2_000_000)
    return stamped.select("session_id", "frame_id", F.coalesce("processing_revision", F.lit(-1)).alias("processing_revision"))


@query("J10_revision_history", """
SELECT 's' || (o_orderkey // 5000) AS session_id, (o_orderkey % 5000) // 1250 AS config_revision, min(o_orderkey % 5000 + 1) AS first_frame_id,
       max(o_orderkey % 5000 + 1) AS last_frame_id, count(*) AS records FROM orders GROUP BY 1, 2""")
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return J.revision_history(cells(spark, sf_dir))


@query("J12_setpoint_dbm", f"""
SELECT p_partkey, {sql6("CASE WHEN p_partkey % 3 = 0 THEN v WHEN v > 0 THEN 10e0 * log10(greatest(v, 1e-300)) ELSE -9999 END", "dbm")}
FROM (SELECT p_partkey, (p_size - 10) / 3e0 AS v FROM part)""")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("p_partkey") % 3 == 0, "dbm").otherwise("mw")
    level = setpoint_dbm((F.col("p_size") - 10) / F.lit(3.0), unit)
    return table(spark, sf_dir, "part").select(
        "p_partkey", r6(F.when(level == float("-inf"), F.lit(-9999.0)).otherwise(level)).alias("dbm"))


@query("A4_coordinate_gate", f"""
SELECT c_name AS stem, CAST(c_custkey % 3 + 1 AS INTEGER) AS version, CASE WHEN c_custkey % 3 = 2 THEN 'ok' WHEN c_nationkey % 4 = 3 THEN 'no_coordinate_frame'
  WHEN c_nationkey % 4 = 0 THEN 'ok' ELSE 'coordinate_frame' END AS verdict FROM customer""")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    headers = customers.select(F.col("c_name").alias("stem"), (F.col("c_custkey") % 3 + 1).cast("int").alias("version"))
    frame = F.when(F.col("c_nationkey") % 4 == 0, F.lit(STANDARD_COORDINATE_FRAME)).otherwise(F.lit("camera"))
    sidecars = customers.where(F.col("c_nationkey") % 4 != 3).select(F.col("c_name").alias("stem"), frame.alias("coordinate_frame"))
    good, bad = A.coordinate_gate(headers, sidecars)
    return good.select("stem", "version", F.lit("ok").alias("verdict")).unionByName(
        bad.select("stem", "version", F.col("reject_reason").alias("verdict")))


def setup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    boards = F.array(*[F.lit(b) for b in ("ats9371", "ats9360", "ats0000")])
    rows = F.array(*[
        F.struct(F.lit(source).alias("source"), F.lit(priority).alias("priority"), (k % divisor != 0).alias("decodable"),
                 F.element_at(boards, ((k + priority) % 3 + 1).cast("int")).alias("board_profile"))
        for source, priority, divisor in (("yaml", 1, 3), ("json", 2, 5))
    ])
    return customers.select("c_custkey", "c_nationkey", F.explode(rows).alias("r")).select(
        F.concat(F.lit("c"), k.cast("string")).alias("session_id"), "r.*", F.concat(F.lit("/data/"), k.cast("string")).alias("directory"),
        F.when(F.col("c_nationkey") % 2 == 0, "/abs/wave.txt").otherwise("wave.txt").alias("waveform_file"))


CANDIDATES = """candidates AS (
  SELECT 'c' || c_custkey AS session_id, source, priority, c_custkey % divisor <> 0 AS decodable,
         (['ats9371', 'ats9360', 'ats0000'])[(c_custkey + priority) % 3 + 1] AS board_profile, '/data/' || c_custkey AS directory,
         CASE WHEN c_nationkey % 2 = 0 THEN '/abs/wave.txt' ELSE 'wave.txt' END AS waveform_file
  FROM customer, (VALUES ('yaml', 1, 3), ('json', 2, 5)) AS v(source, priority, divisor)),
chosen AS (SELECT session_id, min(priority) AS priority FROM candidates WHERE decodable GROUP BY session_id)"""


@query("A13_resolve_recorded_setup", with_ctes(CANDIDATES, select="""
SELECT session_id, source, board_profile, CASE WHEN waveform_file LIKE '/%' THEN waveform_file ELSE directory || '/' || waveform_file END AS waveform_file
FROM candidates JOIN chosen USING (session_id, priority) WHERE board_profile <> 'ats0000'"""))
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    setup, _ = AS.resolve_recorded_setup(setup_candidates(spark, sf_dir), J.boards(spark))
    return setup.select("session_id", "source", "board_profile", "waveform_file")


@query("A13_setup_warnings", with_ctes(CANDIDATES, select="""
SELECT c.session_id, source, 'not_decodable' AS warning FROM candidates c LEFT JOIN chosen h ON c.session_id = h.session_id
WHERE NOT decodable AND (h.priority IS NULL OR c.priority < h.priority) UNION ALL
SELECT session_id, source, 'unknown_board' FROM candidates JOIN chosen USING (session_id, priority) WHERE board_profile = 'ats0000'"""))
def a13_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AS.resolve_recorded_setup(setup_candidates(spark, sf_dir), J.boards(spark))[1]


@query("A14_stream_descriptor_match", """
SELECT 'c' || c_custkey AS session_id, CASE WHEN c_custkey % 20 = 19 THEN 'no_profile' WHEN c_custkey % 7 = 0 THEN 'channel'
  WHEN c_custkey % 11 = 0 THEN 'record_length' WHEN c_custkey % 3 <> 0 AND c_nationkey % 5 = 0 THEN 'records_per_buffer'
  WHEN c_nationkey % 5 = 1 AND c_custkey % 2 = 0 THEN 'sample_rate' ELSE 'ok' END AS verdict FROM customer""")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, k, n = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_nationkey")
    session = F.concat(F.lit("c"), k.cast("string")).alias("session_id")
    # Even keys miss the profile's rate by 2 Hz where the nation asks for it, odd ones by 0.5 Hz.
    drift = F.when(n % 5 == 1, F.when(k % 2 == 0, F.lit(2.0)).otherwise(F.lit(0.5))).otherwise(F.lit(0.0))
    headers = customers.select(
        session, (k % 3 + 1).cast("int").alias("version"), F.when(k % 7 == 0, "b").otherwise("a").alias("channel"),
        F.when(k % 11 == 0, 4000).otherwise(4096).alias("record_length"), F.when(n % 5 == 0, 32).otherwise(64).alias("records_per_buffer"),
        (F.lit(1e8) + drift).alias("sample_rate_hz"))
    profiles = customers.where(k % 20 != 19).select(
        session, F.lit("a").alias("channel"), F.lit(4096).alias("record_length"), F.lit(64).alias("records_per_buffer"),
        F.lit(1e8).alias("sample_rate_hz"))
    good, bad = AS.stream_descriptor_match(headers, profiles)
    return good.select("session_id", F.lit("ok").alias("verdict")).unionByName(bad.select("session_id", F.col("reject_reason").alias("verdict")))
