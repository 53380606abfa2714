"""Connected components as repeated joins: small rows only, no group held in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.skew import join_weighted
from factloom.session import checkpoint


def connected_components(edges: DataFrame, scope: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(scope, node, component) with the smallest node of each component as its name.

    Alternates two contractions until nothing changes: every node hands its larger
    neighbours to its smallest one, then every node its smaller neighbours. The
    minimum is a partial aggregate, so a hub costs one row per task before the
    shuffle, and the round count grows with the logarithm of the diameter.
    """
    ordered = (edges.select(*scope, F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))
    nodes = ordered.select(*scope, F.explode(F.array("lo", "hi")).alias("node")).distinct()
    current = checkpoint(ordered.where("lo <> hi").distinct())
    signature = None
    while True:
        # large star: larger neighbours move to the smallest member of the neighbourhood
        both = current.select(*scope, F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            current.select(*scope, F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy(*scope, "u").agg(F.min("v").alias("m")).select(
            *scope, "u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(least, [*scope, "u"])
                 .select(*scope, F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct())
        # small star: smaller neighbours, and the node itself, move to the smallest one
        low = large.groupBy(*scope, "hi").agg(F.min("lo").alias("m"))
        small = (large.join(low, [*scope, "hi"])
                 .select(*scope, F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")),
                                                   F.struct(F.col("m").alias("lo"), F.col("hi").alias("hi")))).alias("e"))
                 .select(*scope, "e.lo", "e.hi").where("lo <> hi").distinct())
        current = checkpoint(small)
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*scope, "lo", "hi").cast("decimal(38,0)"))).first()
        if seen == signature:
            break
        signature = seen
    return nodes.join(current.select(*scope, F.col("hi").alias("node"), F.col("lo").alias("root")),
                      [*scope, "node"], "left").select(
        *scope, "node", F.coalesce("root", "node").alias("component"))


def connected_components_of_hubs(edges: DataFrame, scope: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """The same for edges with hubs: nodes of any number of neighbours, at the price of more jobs a round.

    Alternates two contractions until nothing changes: every node hands its larger
    neighbours to its smallest one, then every node its smaller neighbours. The
    minimum is a partial aggregate, so a hub costs one row per task before the
    shuffle, a hub's edges stay where they are when they meet its minimum, and the
    round count grows with the logarithm of the diameter.
    """
    ordered = (edges.select(*scope, F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")))
    nodes = ordered.select(*scope, F.explode(F.array("lo", "hi")).alias("node")).distinct()
    current = checkpoint(ordered.where("lo <> hi").distinct())
    signature = None
    while True:
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*scope, "lo", "hi").cast("decimal(38,0)"))).first()
        if seen == signature:
            break
        signature, total = seen, seen[0]
        # large star: larger neighbours move to the smallest member of the neighbourhood
        both = current.select(*scope, F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            current.select(*scope, F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy(*scope, "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select(
            *scope, "u", F.least("u", "m").alias("m"), "n")
        large = (join_weighted(both.where("v > u"), least, [*scope, "u"], "n", total)
                 .select(*scope, F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo <> hi").distinct())
        large = checkpoint(large)
        # small star: smaller neighbours, and the node itself, move to the smallest one
        low = large.groupBy(*scope, "hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (join_weighted(large, low, [*scope, "hi"], "n", total)
                 .select(*scope, F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")),
                                                   F.struct(F.col("m").alias("lo"), F.col("hi").alias("hi")))).alias("e"))
                 .select(*scope, "e.lo", "e.hi").where("lo <> hi").distinct())
        current = checkpoint(small)
    return nodes.join(current.select(*scope, F.col("hi").alias("node"), F.col("lo").alias("root")),
                      [*scope, "node"], "left").select(
        *scope, "node", F.coalesce("root", "node").alias("component"))
