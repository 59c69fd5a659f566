"""Connected components of an edge table of any size, by alternating large and small stars.

Each step hangs neighbours on their smallest known member.  Groups are never
gathered: a step is a hash aggregate and a join, stored before the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("m", "u"))
    return (both.join(least, both.a == least.u).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    hung = down.join(least, down.a == least.u)
    # The largest end of an edge hangs on the smallest, and so does the end between them.
    pair = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("m").alias("y")), F.struct(F.col("b").alias("x"), F.col("m").alias("y"))))
    return hung.select(pair.alias("p")).select(F.col("p.x").alias("a"), F.col("p.y").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; a component is named by its smallest node.

    Nodes are numbers.  Edges with a null end and loops are left out.
    """
    at = written(edges.where("a <> b").select("a", "b").distinct(), "stars")
    seen = None
    while True:
        at = written(_small_star(_large_star(at)), "stars")
        now = tuple(at.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == seen:
            break
        seen = now
    roots = at.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
