"""Scan waveform text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from beamfold.functions.geometry import is_finite


def read_waveform(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``sps <rate>`` then ``X Y M`` rows per file, as (waveform, issues).

    One file is one row and one task's work: a waveform has at most thousands of points, and a fleet
    has many files. Any bad line rejects its file; issues carry file, line number and message.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("_n", "_t")).select(
        "file", (F.col("_n") + 1).alias("line"), F.split(F.trim(F.regexp_replace("_t", r"\s+", " ")), " ").alias("f")
    ).where(F.col("f")[0] != "")
    # The header is the first non-blank line; finding it is a map-side combined minimum.
    first = lines.groupBy("file").agg(F.min("line").alias("_first"), F.count(F.lit(1)).alias("_rows"),
                                      F.min_by("f", "line").alias("_head"))
    rate = F.get("_head", F.lit(1)).try_cast("double")
    good_head = (F.lower(F.get("_head", F.lit(0))) == "sps") & is_finite(rate) & (rate > 0)
    heads = first.withColumn("sample_rate_hz", rate).withColumn("_ok", F.coalesce(good_head, F.lit(False)))
    rows = lines.join(heads, "file").where(F.col("line") > F.col("_first"))
    x, y, m = (F.get("f", F.lit(i)).try_cast("double") for i in range(3))
    rows = rows.select("file", "line", "sample_rate_hz", "_ok", x.alias("x"), y.alias("y"), m.alias("m"))
    bad = ~(is_finite(F.col("x")) & is_finite(F.col("y")) & is_finite(F.col("m")))
    issues = (
        heads.where(~F.col("_ok")).select("file", F.col("_first").alias("line"), F.lit("bad_header").alias("message"))
        .unionByName(heads.where(F.col("_ok") & (F.col("_rows") < 3)).select(
            "file", F.col("_first").alias("line"), F.lit("too_few_points").alias("message")))
        .unionByName(rows.where(F.col("_ok") & bad).select("file", "line", F.lit("bad_row").alias("message")))
        .unionByName(files.where(~F.col("value").rlike(r"\S")).select("file", F.lit(0).alias("line"), F.lit("empty_file").alias("message")))
    )
    clean = rows.join(issues.select("file").distinct(), "file", "left_anti")
    # Blank lines leave holes in line numbers, so points are numbered per file (bounded by one waveform).
    series = clean.groupBy("file").agg(
        F.max("sample_rate_hz").alias("sample_rate_hz"),
        F.sort_array(F.collect_list(F.struct("line", "x", "y", "m"))).alias("_p"))
    waveform = series.select("file", "sample_rate_hz", F.posexplode("_p").alias("idx", "p")).select(
        F.col("file").alias("waveform_id"), F.col("idx").cast("long").alias("idx"), "p.x", "p.y",
        (F.col("p.m") >= 0.5).alias("trigger"), (F.col("p.m") >= 0.5).alias("logical_trigger"), "sample_rate_hz")
    return waveform, issues
