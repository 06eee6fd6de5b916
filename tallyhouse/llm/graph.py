"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.session import materialize


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is its least node.

    Large-star and small-star steps alternate until all hang under roots: each hangs nodes
    under the least neighbour by a map-side minimum and an equi-join, so neither a hub
    nor a component is gathered in one place. The number of steps grows with the
    logarithm of a component's size. Every step is a written table.
    """
    edges = materialize(spark, links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        # large star: neighbours above a node go to its least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its neighbours below go to the least of them
        low = large.where("u <> v")
        under = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(under, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialize(spark, small.unionByName(under.withColumnRenamed("m", "v")).distinct(), "links")
        # done when every node hangs once, under one that hangs nowhere
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
        ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        hung = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if not hung.agg(F.max((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0)))).first()[0]:
            roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
