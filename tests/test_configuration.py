from pyspark.sql import functions as F

from beamfold.operators import configuration as J

LAYERS = "session_id string, layer string, priority int, path string, value string"


def layers(spark, *rows):
    return spark.createDataFrame([("s", *row) for row in rows], LAYERS)


def findings(spark, cases):
    """Rule findings and decode issues of several sessions, each given as its list of overrides."""
    rows = [(name, "profile", 3, path, value) for name, overrides in cases.items()
            for path, value in [("profile.id", "p"), *overrides]]
    config, issues = J.typed_config(J.resolve_config(spark.createDataFrame(rows, LAYERS)))
    found = {name: set() for name in cases}
    for r in J.validate_config(config, J.boards(spark)).collect():
        found[r.session_id].add((r.severity, r.path))
    return found, {(r.path, r.issue) for r in issues.collect()}


def test_defaults_are_valid(spark):
    assert findings(spark, {"s": []}) == ({"s": set()}, set())


def test_later_layers_win_and_unknown_keys_block(spark):
    rows = layers(spark, ("base", 1, "digitizer.sample_point", "1024"), ("profile", 3, "digitizer.sample_point", "2048"))
    assert J.resolve_config(rows).first().value == "2048"
    odd = rows.unionByName(layers(spark, ("base", 1, "digitizer.turbo", "1")))
    schema = J.schema_table(spark)
    assert [r.path for r in J.unknown_keys(odd, schema).collect()] == ["digitizer.turbo"]
    assert J.mergeable(odd, schema).count() == 0 and J.mergeable(rows, schema).count() == 2


def test_rules_fire(spark):
    cases = {
        ("error", "digitizer.board_profile"): [("digitizer.board_profile", "other")],
        ("error", "digitizer.sample_rate_hz"): [("digitizer.sample_rate_hz", "123")],
        ("error", "chirp_segmentation"): [("chirp_segmentation.down_segment.start_sample", "1900")],
        ("error", "chirp_segmentation.guard_samples"): [("chirp_segmentation.guard_samples", "97")],
        ("warning", "chirp_segmentation.segment_fft_length"): [("chirp_segmentation.segment_fft_length", "2000")],
        ("error", "processing.peak_search_end_bin"): [("processing.peak_search_end_bin", "1024")],
        ("error", "udp"): [("udp.enabled", "true"), ("udp.target_ip", "1.2.3.256")],
        ("error", "edfa.output_setpoint"): [("edfa.mode", "controlled"), ("edfa.port", "p"), ("edfa.output_setpoint.unit", "mw"),
                                            ("edfa.output_setpoint.value", "0")],
        ("error", "scan"): [("scan.x_start_deg", "9")],
        ("error", "serial.port_conflict"): [("edfa.mode", "controlled"), ("edfa.port", "p"), ("mcu.enabled", "true"), ("mcu.port", "p")],
        ("error", "calibration"): [("calibration.distance_scale", "0")],
        ("warning", "storage.raw_enabled"): [("storage.raw_enabled", "true")],
        ("error", "digitizer.pre_trigger_samples"): [("digitizer.pre_trigger_samples", "100"), ("digitizer.post_trigger_samples", "3996")],
    }
    found, issues = findings(spark, {f"{severity} {path}": overrides for (severity, path), overrides in cases.items()})
    assert found == {f"{severity} {path}": {(severity, path)} for severity, path in cases} and not issues


def test_addresses(spark):
    rows = [("1.2.3.4", True), ("255.255.255.255", True), ("0.0.0.0", True), ("01.2.3.4", False), ("1.2.3.004", False), ("1.2.3", False),
            ("1.2.3.4.", False), ("1.2.3.256", False), ("", False), ("1..3.4", False)]
    df = spark.createDataFrame(rows, "a string, good boolean")
    assert df.where(J._ipv4(F.col("a")) != F.col("good")).count() == 0


def test_type_and_range_issues(spark):
    _, issues = findings(spark, {"s": [("digitizer.sample_rate_hz", "fast"), ("udp.target_port", "-1"), ("mcu.enabled", "yes"),
                                       ("processing.fft_backend", "abacus")]})
    assert issues == {("digitizer.sample_rate_hz", "type"), ("udp.target_port", "range"), ("mcu.enabled", "type"),
                      ("processing.fft_backend", "enum")}


def test_nearest_record_length(spark):
    rows = spark.createDataFrame([(1,), (256,), (319,), (320,), (321,), (448,)], "r int")
    value = J.nearest_record_length(F.col("r"), F.lit(250), F.lit(128))
    assert [r[0] for r in rows.select(value).collect()] == [256, 256, 256, 384, 384, 512]


def test_update_waits_for_the_next_raster(spark):
    rows = [("s", i, i * 10, (i - 1) % 4 // 2, True) for i in range(1, 13)]
    buffers = spark.createDataFrame(rows, "session_id string, frame_id long, host_timestamp_ns long, y int, ok boolean")
    buffers = buffers.withColumn("pos", F.struct(F.col("y").alias("y_index"), F.col("ok").alias("valid"))).drop("y", "ok")
    updates = spark.createDataFrame([("s", 5, 1), ("s", 72, 2), ("s", 75, 3)], "session_id string, requested_ns long, revision long")
    stamped = {r.frame_id: r.processing_revision for r in J.stamp_processing_revision(buffers, updates, span_ns=25).collect()}
    assert [stamped[i] for i in range(1, 13)] == [1] * 8 + [3] * 4


def test_cluster_without_shared_folder_is_refused():
    from types import SimpleNamespace

    import pytest
    from beamfold.session import shared_folder

    def session(master, configured=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: configured),
                               sparkContext=SimpleNamespace(master=master, applicationId="a", getCheckpointDir=lambda: None))

    with pytest.raises(ValueError):
        shared_folder(session("spark://host:7077"))
    assert shared_folder(session("spark://host:7077", "hdfs://x/y")) == "hdfs://x/y"
    assert shared_folder(session("local[2]")) == shared_folder(session("local[2]"))


def test_fixed_tables_are_what_is_sent(spark):
    """Spark takes an exploded file for small; the resolved values must not be sent to the driver for that."""
    rows = spark.range(20).select(
        F.concat(F.lit("s"), "id").alias("session_id"), F.lit("base").alias("layer"), F.lit(1).alias("priority"),
        F.lit("udp.enabled").alias("path"), F.lit("yes").alias("value"))
    config, issues = J.typed_config(J.resolve_config(rows))
    for df in (config, issues, J.board_capability_check(config, J.boards(spark))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BuildRight" in plan and "BuildLeft" not in plan
    assert issues.count() == 20 and config.count() == 20


def test_layers_are_dealt_before_they_are_put_in_order(spark):
    """Behind an explode a sort in front of the exchange would hold a whole input split."""
    rows = spark.range(300).selectExpr(
        "concat('s', id) AS session_id", "explode(array('base', 'profile')) AS layer", "'udp.enabled' AS path", "concat(id, '') AS value")
    rows = rows.withColumn("priority", F.when(F.col("layer") == "base", 1).otherwise(3))
    resolved = J.resolve_config(rows)
    plan = resolved._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("Sort [") < plan.index("Exchange ") and "Sort [" not in plan[plan.index("Exchange "):]
    assert sorted((r.session_id, r.value, r.layer) for r in resolved.collect()) == sorted((f"s{i}", str(i), "profile") for i in range(300))
