"""Recommendations over interactions (id, user_id, item_id, kind, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph.view import GraphView

#: Added to item ids, so that users and items are different vertices.
ITEM = 1 << 40


def bipartite(interactions: DataFrame) -> GraphView:
    """Users and items, linked both ways."""
    p = interactions.select(F.col("user_id").cast("long").alias("u"), (F.col("item_id").cast("long") + F.lit(ITEM)).alias("i")).distinct()
    return GraphView.frozen(p.select(F.col("u").alias("src"), F.col("i").alias("dst"), F.lit(1.0).alias("weight")).unionAll(p.select(F.col("i"), F.col("u"), F.lit(1.0))))


def recommend_items(g: GraphView, user: int, k: int = 10, pool: int = 40) -> DataFrame:
    """(item_id, score): the best new items among the pool of best new vertices."""
    got = g.recommend(user, pool).where(F.col("id") >= ITEM)
    return got.select((F.col("id") - ITEM).alias("item_id"), "score").orderBy(F.desc("score"), "item_id").limit(k)


def trending(g: GraphView, k: int = 10) -> DataFrame:
    """(item_id, users): items with the most users."""
    return g.edges.where(F.col("dst") >= ITEM).groupBy((F.col("dst") - ITEM).alias("item_id")).agg(F.count("*").alias("users")).orderBy(F.desc("users"), "item_id").limit(k)


def similar_items(g: GraphView, item: int, k: int = 5) -> DataFrame:
    """(item_id, score): Adamic-Adar scores with the items that share a user, for all of them in one job."""
    near = g.edges.where(F.col("src") == item + ITEM).select(F.col("dst").alias("u"))
    deg = g.edges.groupBy(F.col("src").alias("u")).count().where("count > 1")
    pairs = near.join(deg, "u").join(g.edges, F.col("u") == F.col("src")).where(F.col("dst") != item + ITEM)
    return pairs.groupBy((F.col("dst") - ITEM).alias("item_id")).agg(F.sum(1 / F.log("count")).alias("score")).orderBy(F.desc("score"), "item_id").limit(k)
