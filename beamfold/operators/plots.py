"""Plot-oriented reductions: envelopes, runs, ranges, normalised heat maps, exact percentiles."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from beamfold.functions.geometry import finite_or_null, is_finite
from beamfold.operators.ordered import Series, running_sum
from beamfold.session import stage

# Parts an interval is counted in.
BUCKETS = 4096


def envelope(series: DataFrame, columns: int, *, key: str = "series_id") -> DataFrame:
    """Minimum and maximum of the finite values in each of ``columns`` index buckets; empty buckets are absent.

    Bucket c holds rows [c*n div m, (c+1)*n div m), inverted to a direct bucket expression.
    """
    counts = series.groupBy(key).agg((F.max("idx") + 1).cast("long").alias("_n"))
    placed = series.join(counts, key)
    buckets = F.least(F.lit(columns).cast("long"), F.col("_n"))
    bucket = F.floor(((F.col("idx") + 1) * buckets - 1) / F.col("_n")).cast("long")
    return placed.where(is_finite(F.col("value"))).groupBy(key, bucket.alias("bucket")).agg(
        F.min("value").alias("low"), F.max("value").alias("high"))


def finite_runs(series: DataFrame, *, key: str = "series_id", span: int = 1 << 17) -> DataFrame:
    """Gap-free stretches: first and last index and length, named by the gaps before them.

    The count of gaps before a finite value is constant along its stretch and differs between stretches.
    """
    ok = is_finite(F.col("value"))
    counted = running_sum(series.withColumn("_ok", ok), Series((key,), ("idx",), span), {"run": (~ok).cast("long")})
    return counted.where("_ok").groupBy(key, "run").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count(F.lit(1)).alias("length"))


def series_range(series: DataFrame, *, key: str = "plot_id", part: str = "series_id") -> DataFrame:
    """Across the series of a plot: finite minimum and maximum, longest length, whether any has a gap."""
    ok = is_finite(F.col("value"))
    each = series.groupBy(key, part).agg(
        F.count(F.lit(1)).alias("_n"), F.min(finite_or_null(F.col("value"))).alias("_lo"),
        F.max(finite_or_null(F.col("value"))).alias("_hi"), F.max(~ok).alias("_gap"))
    return each.groupBy(key).agg(
        F.min("_lo").alias("minimum"), F.max("_hi").alias("maximum"), F.max("_n").alias("longest"),
        F.max("_gap").alias("contains_gap"))


def heatmap_normalise(bscans: DataFrame, *, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Add ``normalised`` and the range used: (v - min) / (max - min) of valid cells, in-row per frame."""
    cells = F.zip_with("depth", "valid", lambda d, v: F.when(v & is_finite(d), d))
    prepared = bscans.withColumn("_c", cells)
    shown = F.filter("_c", lambda c: c.isNotNull())
    low, high = F.coalesce(F.array_min(shown), F.lit(0.0)), F.coalesce(F.array_max(shown), F.lit(1.0))
    high = F.when(F.abs(high - low) < 1.0e-6, low + 1.0).otherwise(high)
    if lo is not None and hi is not None and lo < hi:
        low, high = F.lit(float(lo)), F.lit(float(hi))
    prepared = prepared.withColumn("range_minimum", low).withColumn("range_maximum", high)
    scaled = F.transform("_c", lambda c: (c - F.col("range_minimum")) / (F.col("range_maximum") - F.col("range_minimum")))
    return prepared.withColumn("normalised", scaled).drop("_c")


def mask_invalid(df: DataFrame, cols: Sequence[str], *, valid: str = "measurement_valid") -> DataFrame:
    ok = F.coalesce(F.col(valid), F.lit(False))
    return df.withColumns({c: F.when(ok, F.col(c)) for c in cols})


def _power_bucket(value: Column) -> Column:
    """Sign and power of two, in the order of the values; NaN above all, as Spark sorts it."""
    real = value.cast("double")
    power = F.floor(F.log2(F.abs(real))) + 1100  # doubles reach down to 2**-1074
    return (F.when(F.isnan(real), F.lit(3000)).when(real == float("inf"), F.lit(2900)).when(real == float("-inf"), F.lit(-2900))
            .when(real == 0, F.lit(0)).when(real > 0, power).otherwise(-power)).cast("int")


def _even_bucket(value: Column, low: Column, high: Column, exact: bool) -> Column:
    """One of ``BUCKETS`` equal parts of [low, high]; the ends never share one."""
    distance = (lambda a, b: (a - b).cast("double")) if exact else (lambda a, b: a.cast("double") - b.cast("double"))
    return F.least(F.floor(distance(value, low) / distance(high, low) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def nearest_rank_percentile(df: DataFrame, col: str, q: float | Sequence[float], *, keys: Sequence[str] = ()) -> DataFrame:
    """Exact nearest-rank percentiles (rank ceil(q*n), at least 1) of the non-NULL numbers per key, one row per ``q``.

    Selection by counting: values are counted per power of two, then per part of the interval that holds the rank, which
    shrinks to the values seen in one part, until these are all equal. A count is map-side combined, so no task holds more than one
    row per part and quantile, whatever the number of values; a double takes six counts at most, mostly three.
    """
    quantiles = [min(max(float(one), 0.0), 1.0) for one in ([q] if isinstance(q, (int, float)) else q)]
    group = list(keys) or ["_all"]
    values = df.where(F.col(col).isNotNull()).select(*keys, *([] if keys else [F.lit(0).alias("_all")]), F.col(col).alias("_v"))
    exact = not isinstance(values.schema["_v"].dataType, (T.FloatType, T.DoubleType))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(one).alias("q")) for i, one in enumerate(quantiles)])

    def narrowed(counts: DataFrame, known: DataFrame | None) -> DataFrame:
        """The bucket of each rank: its least and largest value, and how many values lie below."""
        order = Window.partitionBy(*group, "i").orderBy("_b") if known is not None else Window.partitionBy(*group).orderBy("_b")
        if known is None:
            whole = Window.partitionBy(*group)
            counts = counts.withColumn("_n", F.sum("_m").over(whole)).withColumn("_r", F.sum("_m").over(order)).withColumn("_w", F.explode(wanted)).select(
                *group, "_w.*", "_low", "_high", "_m", "_n", "_r", F.lit(0).cast("long").alias("_below"))
        else:
            counts = counts.withColumn("_r", F.sum("_m").over(order)).join(known.select(*group, "i", "q", "_n", "_below"), [*group, "i"])
        rank = F.greatest(F.ceil(F.col("q") * F.col("_n")), F.lit(1)) - F.col("_below")
        first = counts.where((F.col("_r") >= rank) & (F.col("_r") - F.col("_m") < rank))
        return stage(first.select(*group, "i", "q", "_n", "_low", "_high", (F.col("_below") + F.col("_r") - F.col("_m")).alias("_below")), "ranks")

    ends = F.count(F.lit(1)).alias("_m"), F.min("_v").alias("_low"), F.max("_v").alias("_high")
    state = narrowed(values.groupBy(*group, _power_bucket(F.col("_v")).alias("_b")).agg(*ends), None)
    found = []
    while True:
        found.append(state.where("_low = _high"))
        known = state.where("_low < _high")
        if known.isEmpty():
            break
        spans = known.groupBy(*group).agg(F.collect_list(F.struct("i", "_low", "_high")).alias("_s"))
        inside = F.filter("_s", lambda s: F.col("_v").between(s["_low"], s["_high"]))
        rows = values.join(spans, group).select(*group, "_v", F.explode(inside).alias("_s"))
        bucket = _even_bucket(F.col("_v"), F.col("_s._low"), F.col("_s._high"), exact)
        state = narrowed(rows.groupBy(*group, F.col("_s.i").alias("i"), bucket.alias("_b")).agg(*ends), known)
    out = reduce(DataFrame.unionByName, found)
    return out.select(*keys, "q", F.col("_low").alias("percentile"), F.col("_n").alias("n"))
