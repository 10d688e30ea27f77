"""Connected components of an undirected graph, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import written
from postlake.session import delete


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); ``root`` is the least
    node of its component.

    Alternating large-star and small-star steps (each node links its larger,
    then its smaller neighbours to the least one) until no edge changes; the
    number of rounds grows with the logarithm of the graph.  Every step writes
    its edges to the shared folder and then deletes those of the step before; the
    driver sees two numbers per round.
    """
    now, at = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(small_least, "a")
                 .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                                           F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
                 .select("x.*").where("a <> b").distinct())
        used = at
        now, at = written(small, "edges")
        delete(edges.sparkSession, used)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
