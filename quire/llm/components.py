"""Connected components by alternating large-star and small-star steps.

Edges and labels stay distributed; each step is written to the shared folder. Stars around one
node may be as large as a third of all rows: they are joined on freshly dealt keys, which Spark
can split, and grouped with partial sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, stored


def _star(edges: DataFrame, least: DataFrame) -> DataFrame:
    left = edges.withColumn("k", F.xxhash64("u"))
    right = least.select(F.xxhash64("u").alias("k"), F.col("u").alias("w"), "m")
    return left.join(right, "k").where("u = w").select("u", "v", "m")


def large_star(edges: DataFrame) -> DataFrame:
    """May hold an edge more than once, but no more rows than there are edges."""
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    up = edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
    return _star(up, least).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    # both ends in one pass over the join
    ends = _star(down, least).select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return ends.where("a <> b").distinct()


def only_stars(edges: DataFrame) -> bool:
    """Whether each node is a centre or has one edge to a centre: no further step changes such edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of the edges a, b (long, not null)."""
    spark = edges.sparkSession
    now, path = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        after, new = stored(small_star(large_star(now)), "stars")
        discard(spark, path)  # the new table holds all that is still read
        now, path = after, new
        if only_stars(now):
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
