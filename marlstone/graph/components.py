"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import written


def _print(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return r["n"], r["h"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component): the smallest id reachable over the edges, in either direction.

    Nodes that only have edges to themselves are their own component; null ends are ignored.  Each
    round contracts the edges towards their local minimum, so rounds grow with the logarithm of the
    longest path, and they go on until one changes nothing; every round is written to the shared
    folder, so no lineage piles up.
    """
    ends = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).where("x is not null and y is not null")
    e = written(ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "components")
    before = _print(e)
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        at_u = Window.partitionBy("u").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        large = both.withColumn("m", F.least("u", F.first("v").over(at_u))).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        at_a = Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        small = large.withColumn("m", F.first("b").over(at_a)).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        e = written(small.select("e.a", "e.b").where("a <> b").distinct(), "components", instead_of=e)
        now = _print(e)
        if now == before:
            break
        before = now
    stars = e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    roots = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    alone = ends.where("x = y").select(F.col("x").alias("id")).distinct().join(stars.unionAll(roots), "id", "left_anti").withColumn("component", F.col("id"))
    return stars.unionAll(roots).unionAll(alone)
