"""Connected components of a link table, by alternating star contractions over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from beamfold.session import stage


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) of longs. Returns (key, comp) for every key with a link; comp is the smallest key reachable.

    Each step sends every neighbour of a key to the smallest one it knows, first over the larger neighbours, then over the
    smaller ones; a path halves at least. A step is one written table, so a lost executor costs a step at most.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        smaller = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smaller, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        before, edges = edges, stage(small.where("u <> v").distinct(), "links")
        # Edges of a step are distinct, so two steps are alike if none of one is missing in the other and they have one size.
        if edges.count() == before.count() and edges.join(before, ["u", "v"], "left_anti").isEmpty():
            break
    found = edges.select(F.col("u").alias("key"), F.col("v").alias("comp"))
    return stage(found.unionAll(edges.select(F.col("v").alias("key"), F.col("v").alias("comp")).distinct()), "components")
