"""Explicit schemas of the scan tables."""

from pyspark.sql import types as T

SEGMENT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end_excl", T.IntegerType())])

TRIGGER = T.StructType([
    T.StructField("sequence", T.LongType()),
    T.StructField("timestamp_ns", T.LongType()),
    T.StructField("period_jitter_ns", T.LongType()),
    T.StructField("missed_trigger_count", T.LongType()),
    T.StructField("valid", T.BooleanType()),
])

POSITION = T.StructType([
    T.StructField("x_index", T.IntegerType()),
    T.StructField("y_index", T.IntegerType()),
    T.StructField("trajectory_sample_index", T.LongType()),
    T.StructField("x_command", T.DoubleType()),
    T.StructField("y_command", T.DoubleType()),
    T.StructField("x_angle_deg", T.DoubleType()),
    T.StructField("y_angle_deg", T.DoubleType()),
    T.StructField("fast_axis", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("angle_calibrated", T.BooleanType()),
    T.StructField("valid", T.BooleanType()),
])

OPTICAL = T.StructType([
    T.StructField("revision", T.LongType()),
    T.StructField("laser_enabled", T.BooleanType()),
    T.StructField("edfa_used", T.BooleanType()),
    T.StructField("edfa_output_enabled", T.BooleanType()),
])

ASCANS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("frame_id", T.LongType()),
    T.StructField("dma_buffer_sequence", T.LongType()),
    T.StructField("record_index_in_buffer", T.IntegerType()),
    T.StructField("records_in_buffer", T.IntegerType()),
    T.StructField("host_timestamp_ns", T.LongType()),
    T.StructField("config_revision", T.LongType()),
    T.StructField("trigger", TRIGGER),
    T.StructField("pos", POSITION),
    T.StructField("optical", OPTICAL),
    T.StructField("channel", T.StringType()),
    T.StructField("sample_format", T.StringType()),
    T.StructField("frame_kind", T.StringType()),
    T.StructField("sample_rate_hz", T.DoubleType()),
    T.StructField("record_length", T.IntegerType()),
    T.StructField("pre_trigger_samples", T.LongType()),
    T.StructField("post_trigger_samples", T.LongType()),
    T.StructField("up_segment", SEGMENT),
    T.StructField("down_segment", SEGMENT),
    T.StructField("samples", T.ArrayType(T.ShortType())),
])

# The store's form of a record: the same columns with the samples as one little-endian 16-bit payload.
PACKED_ASCANS = T.StructType([f for f in ASCANS if f.name != "samples"] + [T.StructField("payload", T.BinaryType())])

PEAK = T.StructType([
    T.StructField("discrete_bin", T.IntegerType()),
    T.StructField("peak_bin", T.DoubleType()),
    T.StructField("magnitude_db", T.DoubleType()),
    T.StructField("valid", T.BooleanType()),
])

PEAK_PAIR = T.StructType([T.StructField("up", PEAK), T.StructField("down", PEAK)])

SPECTRUM = T.StructType([
    T.StructField("re", T.ArrayType(T.DoubleType())),
    T.StructField("im", T.ArrayType(T.DoubleType())),
])

POINT = T.StructType([
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("z", T.DoubleType()),
    T.StructField("intensity", T.DoubleType()),
    T.StructField("velocity", T.DoubleType()),
    T.StructField("scan_x", T.DoubleType()),
    T.StructField("scan_y", T.DoubleType()),
    T.StructField("valid", T.BooleanType()),
])

PACKET_POINT = T.StructType([
    T.StructField(name, T.FloatType()) for name in ("x", "y", "z", "intensity", "velocity")
])

SESSIONS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("profile_id", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("application_version", T.StringType()),
    T.StructField("config_schema_version", T.IntegerType()),
    T.StructField("start_timestamp_utc_ns", T.LongType()),
    T.StructField("end_timestamp_utc_ns", T.LongType()),
    T.StructField("stream_type", T.StringType()),
    T.StructField("data_format_version", T.IntegerType()),
    T.StructField("completed", T.BooleanType()),
    T.StructField("stop_reason", T.StringType()),
    T.StructField("coordinate_frame", T.StringType()),
    T.StructField("blocks_written", T.LongType()),
    T.StructField("frames_written", T.LongType()),
    T.StructField("bytes_written", T.LongType()),
    T.StructField("data_files", T.ArrayType(T.StringType())),
    T.StructField("raw_stream", T.StructType([
        T.StructField("format_version", T.IntegerType()),
        T.StructField("channel", T.StringType()),
        T.StructField("sample_rate_hz", T.DoubleType()),
        T.StructField("record_length", T.IntegerType()),
        T.StructField("records_per_buffer", T.IntegerType()),
    ])),
    T.StructField("setup_file", T.StringType()),
    T.StructField("config_snapshot", T.MapType(T.StringType(), T.StringType())),
])

# The coordinate contract and the sample-format names used in every table.
STANDARD_COORDINATE_FRAME = "ros_x_forward_y_left_z_up"
SIGNED_INT16 = "signed_int16"
FULL_CHIRP_PERIOD = "full_chirp_period"
OFFSET_BINARY_12 = "unsigned_offset_binary_12_left_aligned"
