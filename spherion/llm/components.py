"""Connected components by repeated contraction, wholly as DataFrame joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spherion.llm.shared import written


def scrambled(x: Column) -> Column:
    """A bijection on 64-bit integers that leaves no order: chains of rising ids would contract one step a round."""
    for seed in (0x2545F4914F6CDD1D, 0x1B873593CC9E2D51):
        x = x.bitwiseXOR(F.lit(seed))
        x = x.bitwiseXOR(F.shiftleft(x, 13))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
        x = x.bitwiseXOR(F.shiftleft(x, 17))
    return x


def _distinct_edges(e: DataFrame) -> DataFrame:
    return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component) for every id that has an edge; component is the smallest id that edges reach.

    ``edges`` has two long columns.  Null ends and loops are ignored; repeated edges count once; no edges
    give no rows.  Each round maps a vertex to the least of its neighbours under a scrambled order and
    contracts, which leaves a fixed fraction of the vertices, so the rounds are logarithmic.
    """
    named = edges.toDF("x", "y").where("x is not null and y is not null and x <> y")
    e = written(spark, _distinct_edges(named.select(scrambled(F.col("x")).alias("a"), scrambled(F.col("y")).alias("b"))), "edges")
    names = named.select(F.explode(F.array("x", "y")).alias("id")).distinct().select("id", scrambled(F.col("id")).alias("root"))
    while not e.isEmpty():
        ends = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(spark, ends.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("u")).alias("p")), "hooks")
        pa, pb = to.toDF("a", "pa"), to.toDF("b", "pb")
        moved = e.join(pa, "a").join(pb, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))
        e = written(spark, _distinct_edges(moved), "edges")
        names = names.join(to.toDF("root", "p"), "root", "left").select("id", F.coalesce("p", "root").alias("root"))
    names = written(spark, names, "roots")
    least = names.groupBy("root").agg(F.min("id").alias("component"))
    return names.join(least, "root").select("id", "component")
