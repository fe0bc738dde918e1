"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stored


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """`node`, `root`: the smallest id reachable over `links` (`a`, `b`: bigint). Only nodes with a
    link are listed. Rounds of large stars and small stars: every node points at the smallest id it
    knows, so long chains shorten by a factor in each round; neighbours are never collected."""
    edges = stored(
        spark,
        links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node that is the smallest of its own neighbourhood keeps its links through the others.
        large = large.where("u != v").distinct()
        large = stored(spark, large, "large-stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = low.select("u", F.col("m").alias("v")).unionByName(moved).distinct()
        edges = stored(spark, small, "small-stars")
        # Done when every node points at one root and no root points on.
        ends = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        roots = edges.select(F.col("v").alias("u")).distinct().withColumn("n", F.lit(1).cast("bigint"))
        if ends.unionByName(roots).groupBy("u").agg(F.sum("n").alias("n")).where("n > 1").isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
