"""Exact percentiles of groups that one task couldn't hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written


def percentiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(by, a column for each of ``shares``): percentiles of a double column, interpolated as by percentile_cont; null for a group without values.

    Spark's own aggregate gathers a group's distinct values in one task.  Here they are counted and
    spread by ranges, of which each counts its own, and only the ranges' sums are added up in one place.
    """
    counted = df.select(F.col(by).alias("g"), F.col(value).alias("v")).groupBy("g", "v").agg(F.count("*").alias("n"))
    ranged = written(counted.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "percentiles")
    some = ranged.where("v is not null")
    g = Window.partitionBy("g")
    sums = some.groupBy("g", "part").agg(F.sum("n").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(g.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("s").over(g))
    sums = F.broadcast(sums.select(F.col("g").alias("_g"), F.col("part").alias("_part"), "before", "all"))
    upto = F.sum("n").over(Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    each = some.withColumn("upto", upto).join(sums, F.col("g").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_part"))).withColumn("upto", F.col("before") + F.col("upto"))
    holds = lambda k: F.max(F.when((F.col("upto") > k) & (F.col("upto") - F.col("n") <= k), F.col("v")))
    found, out = [F.max("all").alias("all")], []
    for name, p in shares.items():
        place = F.lit(p) * (F.col("all") - 1)
        found += [holds(F.floor(place)).alias(f"lo_{name}"), holds(F.ceil(place)).alias(f"hi_{name}")]
        lo, hi = F.col(f"lo_{name}"), F.col(f"hi_{name}")
        out.append(F.when(F.floor(place) == F.ceil(place), lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi).alias(name))
    got = each.groupBy("g").agg(*found).withColumnRenamed("g", "_g")
    every = ranged.select("g").distinct()
    return every.join(got, F.col("g").eqNullSafe(F.col("_g")), "left").select(F.col("g").alias(by), *out)
