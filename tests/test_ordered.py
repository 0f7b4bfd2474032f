import random

from pyspark.sql import Window, functions as F

from beamfold.operators.ordered import Series, carry_forward, following, ordinal, previous, row_index, rows_since, running_sum

SERIES = Series(("k",), ("t", "u"), 7)


def rows(spark):
    random.seed(3)
    data, seen = [], set()
    for _ in range(400):
        key = random.choice("aaab")  # one key holds three quarters of the rows
        place = (key, random.randrange(-40, 200), random.randrange(5))
        if place not in seen:
            seen.add(place)
            data.append((*place, random.randrange(100), random.random() < 0.1))
    return spark.createDataFrame(data, "k string, t long, u int, v int, f boolean")


def test_chunked_primitives_equal_plain_windows(spark):
    df = rows(spark).cache()
    w = Window.partitionBy("k").orderBy("t", "u")
    whole = w.rowsBetween(Window.unboundedPreceding, 0)
    expected = df.select(
        "k", "t", "u", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"), F.sum("v").over(whole).alias("s"),
        (F.row_number().over(w) - 1).alias("i"), F.count("v").over(Window.partitionBy("k")).alias("total"),
        F.last(F.when(F.col("f"), F.col("v")), ignorenulls=True).over(whole).alias("c"))
    got = previous(df, SERIES, {"p": "v"})
    got = following(got, SERIES, {"n": "v"})
    got = running_sum(got, SERIES, {"s": F.col("v")})
    got = row_index(got, SERIES, "i", total="total")
    got = carry_forward(got, SERIES, {"c": F.when(F.col("f"), F.col("v"))})
    columns = ["k", "t", "u", "p", "n", "s", "i", "total", "c"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, expected.select(*columns).collect()))


def test_rows_since_counts_back_to_the_flag(spark):
    df = rows(spark)
    got = {(r.k, r.t, r.u): r.since for r in rows_since(df, SERIES, {"since": F.col("f")}).collect()}
    for key in "ab":
        since = None
        for r in sorted((r for r in df.collect() if r.k == key), key=lambda r: (r.t, r.u)):
            since = 0 if r.f else None if since is None else since + 1
            assert got[(r.k, r.t, r.u)] == since


def test_ordinal_is_dense_rank(spark):
    df = rows(spark)
    expected = df.withColumn("o", F.dense_rank().over(Window.partitionBy("k").orderBy("t")) - 1)
    assert sorted(map(str, ordinal(df, ["k"], "t", "o", span=7).collect())) == sorted(map(str, expected.select(
        *ordinal(df, ["k"], "t", "o").columns).collect()))
