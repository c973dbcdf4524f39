"""Connected components of a link table by repeated minimum labels, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp), written: the smallest node reachable, for each node of ``links(a, b)``.

    Alternates large-star and small-star steps; each is one grouped minimum and one join, so a hot node is
    pre-aggregated before its shuffle and its join partition is split by AQE. Rounds are logarithmic in the
    diameter. Empty links give an empty table."""
    edges = scratch.cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # large star: larger neighbours of a node hang under the least node of its neighbourhood
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours of a node and itself hang under the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        new = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.cut(new)
        # a forest of stars: no node is both a leaf and a centre, and each leaf has one centre
        state = new.groupBy("u").agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0
        nested = new.select("u").join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        scratch.free(edges)
        edges = new
        if state <= 1 and not nested:
            break
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    out = scratch.cut(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots))
    scratch.free(edges)
    return out
