"""A graph kept as a keyed edge table of a database."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..database import Database
from .view import GraphView


class GraphStore:
    """Edges in the table ``<name>_edges``; adding an edge again replaces its weight."""

    def __init__(self, db: Database, name: str):
        self.db, self.table = db, f"{name}_edges"
        db.table_or_create(f"CREATE TABLE {self.table} (key TEXT PRIMARY KEY, src BIGINT NOT NULL, dst BIGINT NOT NULL, weight DOUBLE)")

    def add_edges(self, edges: list[tuple] | DataFrame) -> int:
        """Upserts (src, dst) or (src, dst, weight) rows in one commit."""
        if isinstance(edges, list):
            edges = self.db.spark.createDataFrame([(int(e[0]), int(e[1]), float(e[2]) if len(e) > 2 else 1.0) for e in edges], "src long, dst long, weight double")
        last = edges.withColumn("_i", F.monotonically_increasing_id()).groupBy("src", "dst").agg(F.max_by("weight", "_i").alias("weight"))
        return self.db.upsert(self.table, last.select(F.concat_ws(":", "src", "dst").alias("key"), "src", "dst", "weight"))

    def add_edge(self, src: int, dst: int, weight: float = 1.0) -> int:
        return self.add_edges([(src, dst, weight)])

    def out_neighbors(self, node: int) -> DataFrame:
        """Read from the table as it is now, without a view: a range of keys, which begin with the source."""
        return self.db.scan_key_range(self.table, f"{int(node)}:", f"{int(node)};").select(F.col("dst").alias("id"))

    def view(self, csn: int | None = None) -> GraphView:
        """A snapshot that later writes don't reach."""
        return GraphView(self.db.table(self.table, self.db.csn() if csn is None else csn))
