"""Graph analytics over an immutable edge table.

A graph is directed, simple and weighted: one edge for each (src, dst); a null weight is 1.  Its
vertices are the ids that occur in an edge.  Every method returns a DataFrame unless its answer is
one value; unknown vertices give empty answers, never errors.  Iterative methods are loops over
joins and aggregations whose state is written to the shared folder each round, so lineage stays
short and a lost executor costs one round at most; the driver only sees one-row aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import written
from .components import connected_components


class GraphView:
    """Edges (src, dst, weight) as they were when the view was made."""

    def __init__(self, edges: DataFrame):
        e = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"))
        self.edges = e.where("src is not null and dst is not null")
        self.spark = edges.sparkSession

    @classmethod
    def frozen(cls, edges: DataFrame) -> GraphView:
        """A view on a copy of the edges in the shared folder."""
        return cls(written(cls(edges).edges, "graph"))

    # counts, degrees, neighbours
    def vertices(self) -> DataFrame:
        return self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()

    def node_count(self) -> int:
        return self.vertices().count()

    def edge_count(self) -> int:
        return self.edges.count()

    def degrees(self) -> DataFrame:
        """(id, out_degree, in_degree) of every vertex, in one shuffle."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
        return ends.groupBy("e.id").agg(F.sum("e.o").cast("long").alias("out_degree"), F.sum("e.i").cast("long").alias("in_degree"))

    def out_neighbors(self, node: int) -> DataFrame:
        return self.edges.where(F.col("src") == node).select(F.col("dst").alias("id"))

    def in_neighbors(self, node: int) -> DataFrame:
        return self.edges.where(F.col("dst") == node).select(F.col("src").alias("id"))

    def out_degree(self, node: int) -> int:
        return self.out_neighbors(node).count()

    def in_degree(self, node: int) -> int:
        return self.in_neighbors(node).count()

    # paths
    def bfs(self, start: int) -> DataFrame:
        """(id, hops) of every vertex reachable from start."""
        seen = written(self.vertices().where(F.col("id") == start).select("id", F.lit(0).cast("long").alias("hops")), "bfs")
        front, hops = seen, 0
        while not front.isEmpty():
            hops += 1
            nxt = front.join(self.edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
            front = written(nxt.join(seen, "id", "left_anti").withColumn("hops", F.lit(hops).cast("long")), "bfs")
            seen = seen.unionAll(front)
        return seen

    def shortest_path(self, a: int, b: int) -> list[int] | None:
        """Vertices of a path of fewest hops, ends included; of several the smallest in order."""
        if self.vertices().where(F.col("id").isin(a, b)).count() < (1 if a == b else 2):
            return None
        if a == b:
            return [a]
        front = self.spark.createDataFrame([(a, [a])], "id long, path array<long>")
        seen = front.select("id")
        while not front.isEmpty():
            nxt = front.join(self.edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
            front = written(nxt.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")), "path")
            hit = front.where(F.col("id") == b).first()
            if hit:
                return list(hit["path"])
            seen = seen.unionAll(front.select("id"))
        return None

    def _costs(self, source: int, paths: bool) -> DataFrame:
        """(id, cost, path): relaxed until nothing changes; only vertices that improved are relaxed again.  Without ``paths`` they stay empty."""
        best = written(self.vertices().where(F.col("id") == source).select("id", F.lit(0.0).alias("cost"), (F.array("id") if paths else F.array().cast("array<long>")).alias("path")), "costs")
        front = best
        while not front.isEmpty():
            step = front.join(self.edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), (F.col("cost") + F.greatest("weight", F.lit(0.0))).alias("cost"), (F.concat("path", F.array("dst")) if paths else F.col("path")).alias("path"))
            step = step.groupBy("id").agg(F.min(F.struct("cost", "path")).alias("n")).select("id", F.col("n.cost").alias("n_cost"), F.col("n.path").alias("n_path"))
            both = written(best.join(step, "id", "full").withColumn("better", F.col("n_cost").isNotNull() & (F.col("cost").isNull() | (F.col("n_cost") < F.col("cost")))), "costs")
            pick = lambda c: F.when(F.col("better"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
            best = both.select("id", pick("cost"), pick("path"))
            front = both.where("better").select("id", F.col("n_cost").alias("cost"), F.col("n_path").alias("path"))
        return best

    def dijkstra(self, source: int) -> DataFrame:
        """(id, cost) of the cheapest way to every reachable vertex; a negative weight counts as 0."""
        return self._costs(source, False).select("id", "cost")

    def weighted_shortest_path(self, a: int, b: int) -> tuple[list[int], float] | None:
        row = self._costs(a, True).where(F.col("id") == b).first()
        return (list(row["path"]), row["cost"]) if row else None

    def topological_order(self) -> DataFrame | None:
        """(id, level), in order by level then id; None if there is a cycle."""
        left, level, done = written(self.edges.select("src", "dst"), "topo"), 0, None
        nodes = written(self.vertices(), "topo")
        while not nodes.isEmpty():
            free = written(nodes.join(left.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level).cast("long")), "topo")
            if free.isEmpty():
                return None
            done = free if done is None else done.unionAll(free)
            nodes = written(nodes.join(free, "id", "left_anti"), "topo")
            left = written(left.join(free.select(F.col("id").alias("src")), "src", "left_anti"), "topo")
            level += 1
        if done is None:
            return self.vertices().withColumn("level", F.lit(0).cast("long"))
        return done.orderBy("level", "id")

    # ranks
    def _rank(self, start: DataFrame, iterations: int, damping: float) -> DataFrame:
        """start: (id, base) with the teleport share of each vertex, which is also the first rank.

        The rank of a vertex that nothing points to is its base times one factor, the same for all of
        them, so what these send is summed up once, and only the other vertices and the edges between
        them take part in the steps.
        """
        out = self.edges.groupBy("src").agg(F.count("*").alias("n"))
        into = self.edges.select(F.col("dst").alias("id")).distinct().withColumn("inner", F.lit(True))
        base = start.join(out.withColumnRenamed("src", "id"), "id", "left").join(into, "id", "left")
        base = written(base.select("id", "base", "n", F.coalesce("inner", F.lit(False)).alias("inner")), "base")
        from_ = base.where("n is not null").select(F.col("id").alias("src"), (1.0 / F.col("n")).alias("share"), (F.col("base") / F.col("n")).alias("fixed"), "inner")
        sends = self.edges.select("src", "dst").join(from_, "src")
        fixed = sends.where("not inner").groupBy(F.col("dst").alias("id")).agg(F.sum("fixed").alias("fixed"))
        core = written(sends.where("inner").select("src", "dst", "share"), "shares")
        live = written(base.where("inner").join(fixed, "id", "left").select("id", "base", F.coalesce("fixed", F.lit(0.0)).alias("fixed"), F.col("n").isNull().alias("end")), "inner")
        rank, factor, alone = live.select("id", "base", "fixed", "end", F.col("base").alias("rank")), 1.0, core.isEmpty()
        for _ in range(iterations):
            # what a vertex without out-edges has goes to no vertex in particular
            lost = rank.where("end").agg(F.sum("rank").alias("lost")).first()["lost"] or 0.0
            got, was = F.col("fixed") * factor, rank
            if not alone:
                sent = rank.select("id", "rank").join(core, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
                rank, got = rank.join(sent, F.col("id") == F.col("dst"), "left"), got + F.coalesce("got", F.lit(0.0))
            new = F.col("base") * (1 - damping) + damping * (got + F.lit(lost) * F.col("base"))
            rank = written(rank.select("id", "base", "fixed", "end", new.alias("rank")), "rank", instead_of=was)
            factor = (1 - damping) + damping * lost
        return rank.select("id", "rank").unionAll(base.where("not inner").select("id", (F.col("base") * factor).alias("rank")))

    def pagerank(self, iterations: int = 20, damping: float = 0.85) -> DataFrame:
        """(id, rank) after exactly so many steps; the rank of vertices without out-edges spreads evenly."""
        nodes = written(self.vertices(), "nodes")
        n = nodes.count()
        return self._rank(nodes.withColumn("base", F.lit(1.0 / n if n else 0.0)), iterations, damping)

    def personalized_pagerank(self, seeds: list[int] | DataFrame, iterations: int = 40, damping: float = 0.85) -> DataFrame:
        """(id, rank) with teleports and lost rank going back to the known seeds, a list or a table of (id); empty without any."""
        if isinstance(seeds, list):
            seeds = self.spark.createDataFrame([(int(s),) for s in seeds], "id long")
        known = seeds.select(F.col("id").cast("long").alias("id")).distinct().withColumn("_s", F.lit(True))
        nodes = written(self.vertices().join(known, "id", "left").select("id", F.coalesce("_s", F.lit(False)).alias("seed")), "nodes")
        k = nodes.where("seed").count()
        if not k:
            return nodes.limit(0).select("id", F.lit(0.0).alias("rank"))
        return self._rank(nodes.select("id", F.when(F.col("seed"), 1.0 / k).otherwise(0.0).alias("base")), iterations, damping)

    def recommend(self, seed: int, k: int = 10) -> DataFrame:
        """(id, score): the k highest personalized ranks outside the seed and what it already points to; ties by id."""
        known = self.out_neighbors(seed).unionAll(self.vertices().where(F.col("id") == seed))
        ranked = self.personalized_pagerank([seed]).join(known, "id", "left_anti").where("rank > 0")
        return ranked.select("id", F.col("rank").alias("score")).orderBy(F.desc("score"), "id").limit(k)

    # components and communities
    def connected_components(self) -> DataFrame:
        """(id, component): 0, 1, ... by the smallest id of each weakly connected component.

        Roots are numbered by ranges: each range counts its own, and only the ranges' sums are added
        up in one place.
        """
        found = written(connected_components(self.edges), "wcc")
        roots = found.select("component").distinct()
        ranged = written(roots.repartitionByRange("component").select("component", F.spark_partition_id().alias("part")), "roots")
        sums = ranged.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
        dense = ranged.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("component"))).join(F.broadcast(sums), "part")
        dense = dense.select("component", (F.coalesce("before", F.lit(0)) + F.col("at") - 1).cast("long").alias("dense"))
        return found.join(dense, "component").select("id", F.col("dense").alias("component"))

    def strongly_connected_components(self) -> DataFrame:
        """(id, component): the smallest id of each strongly connected component.

        Rounds of colouring: vertices without an in- or out-edge among those left are components of
        their own; the others take the smallest id that reaches them, and what reaches that id
        back within its colour is its component.
        """
        e = written(self.edges.select("src", "dst").where("src <> dst"), "scc")
        nodes = written(self.vertices(), "scc")
        done = nodes.limit(0).select("id", F.col("id").alias("component"))
        while not nodes.isEmpty():
            core = written(nodes.join(e.select(F.col("src").alias("id")).distinct(), "id", "left_semi").join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_semi"), "scc")
            done = done.unionAll(nodes.join(core, "id", "left_anti").select("id", F.col("id").alias("component")))
            e2 = written(_within(e, core), "scc")
            if core.count() == nodes.count():
                color = self._smallest(core, e2)
                back = written(color.where("id = color"), "scc")
                front = back
                inside = written(e2.join(color.withColumnRenamed("id", "src").withColumnRenamed("color", "cs"), "src").join(color.withColumnRenamed("id", "dst").withColumnRenamed("color", "cd"), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("color")), "scc")
                while not front.isEmpty():
                    nxt = front.join(inside.select(F.col("dst").alias("id"), "src"), "id").select(F.col("src").alias("id"), "color").distinct()
                    front = written(nxt.join(back, "id", "left_anti"), "scc")
                    back = back.unionAll(front)
                done = done.unionAll(back.select("id", F.col("color").alias("component")))
                core = written(core.join(back, "id", "left_anti"), "scc")
                e2 = written(_within(e2, core), "scc")
            nodes, e = core, e2
        return written(done, "scc")

    def _smallest(self, nodes: DataFrame, edges: DataFrame) -> DataFrame:
        """(id, color): the smallest vertex that reaches each one."""
        color = written(nodes.select("id", F.col("id").alias("color")), "color")
        front = color
        while not front.isEmpty():
            got = front.join(edges, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.min("color").alias("new"))
            both = written(color.join(got, "id", "left").withColumn("less", F.coalesce(F.col("new") < F.col("color"), F.lit(False))), "color")
            color = both.select("id", F.when(F.col("less"), F.col("new")).otherwise(F.col("color")).alias("color"))
            front = both.where("less").select("id", F.col("new").alias("color"))
        return color

    def laundering_cycles(self) -> DataFrame:
        """(component, members): the strongly connected components of two vertices or more."""
        return self.strongly_connected_components().groupBy("component").agg(F.sort_array(F.collect_list("id")).alias("members")).where(F.size("members") >= 2)

    def _undirected(self) -> DataFrame:
        """(a, b), a < b: each pair of neighbours once."""
        return self.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    def triangle_count(self) -> DataFrame:
        """(triangles): in the undirected graph without loops, each once.  Edges point from the vertex of lower degree, so no vertex fans out widely."""
        u = written(self._undirected(), "undirected")
        deg = u.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count()
        da, db = deg.select(F.col("id").alias("a"), F.col("count").alias("da")), deg.select(F.col("id").alias("b"), F.col("count").alias("db"))
        up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
        o = u.join(da, "a").join(db, "b").select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("t"))
        o = written(o, "oriented")
        wedge = o.alias("x").join(o.alias("y"), F.col("x.s") == F.col("y.s")).where("x.t <> y.t").select(F.col("x.t").alias("s"), F.col("y.t").alias("t"))
        return wedge.join(o, ["s", "t"]).agg(F.count("*").alias("triangles"))

    def label_propagation(self, iterations: int = 10) -> DataFrame:
        """(id, label): labels are dense indices by ascending id, updated in place in that order; see ``label_rounds`` for graphs of any size.

        Each vertex takes the commonest label among its out- and in-neighbours (an edge both ways
        counts twice), ties to the lowest, until nothing changes.  The order of updates is part of
        the result, so one task holds the whole graph.
        """

        def run(pdf):
            import numpy as np
            import pandas as pd

            ids = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]))
            s, d = np.searchsorted(ids, pdf["src"].to_numpy()), np.searchsorted(ids, pdf["dst"].to_numpy())
            x, y = np.concatenate([s, d]), np.concatenate([d, s])
            order = np.argsort(x, kind="stable")
            y, at = y[order], np.searchsorted(x[order], np.arange(len(ids) + 1))
            label = np.arange(len(ids))
            for _ in range(iterations):
                moved = False
                for v in range(len(ids)):
                    near = label[y[at[v] : at[v + 1]]]
                    if len(near):
                        names, count = np.unique(near, return_counts=True)
                        new = names[np.argmax(count)]
                        moved |= new != label[v]
                        label[v] = new
                if not moved:
                    break
            return pd.DataFrame({"id": ids, "label": label.astype("int64")})

        return self.edges.select("src", "dst", F.lit(1).alias("all")).groupBy("all").applyInPandas(lambda pdf: run(pdf), "id long, label long")

    def label_rounds(self, iterations: int = 10) -> DataFrame:
        """(id, label): label propagation in rounds, all vertices at once and without one place for the whole graph.

        Labels start as the vertices' ids.  In each round every vertex takes the commonest label among
        itself and its out- and in-neighbours (an edge both ways counts twice), ties to the lowest,
        until nothing changes or the rounds are over.
        """
        near = written(self.edges.select(F.col("src").alias("id"), F.col("dst").alias("nb")).unionAll(self.edges.select(F.col("dst").alias("id"), F.col("src").alias("nb"))).unionAll(self.vertices().select("id", F.col("id").alias("nb"))), "labels")
        label = written(self.vertices().select("id", F.col("id").alias("label")), "labels")
        for _ in range(iterations):
            seen = near.join(label.withColumnRenamed("id", "nb"), "nb").groupBy("id", "label").agg(F.count("*").alias("n"))
            best = seen.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("c"), "label")).alias("b"))
            both = written(label.withColumnRenamed("label", "was").join(best, "id").select("id", F.col("b.label").alias("label"), (F.col("b.label") != F.col("was")).alias("moved")), "labels", instead_of=label)
            label = both.select("id", "label")
            if both.where("moved").isEmpty():
                break
        return label

    def k_core(self) -> DataFrame:
        """(id, core): core numbers of the undirected graph; a vertex with only loops has 0.

        Each vertex's estimate falls to the h-index of its neighbours' until none changes, which
        needs far fewer rounds than peeling.
        """
        u = self._undirected()
        near = written(u.select(F.col("a").alias("id"), F.col("b").alias("nb")).unionAll(u.select(F.col("b").alias("id"), F.col("a").alias("nb"))), "core")
        est = written(self.vertices().join(near.groupBy("id").count(), "id", "left").select("id", F.coalesce("count", F.lit(0)).alias("core")), "core")
        while True:
            w = Window.partitionBy("id").orderBy(F.desc("core"))
            h = near.join(est.select(F.col("id").alias("nb"), "core"), "nb").withColumn("r", F.row_number().over(w)).groupBy("id").agg(F.max(F.least("r", "core")).alias("h"))
            new = written(est.join(h, "id", "left").select("id", F.least("core", F.coalesce("h", F.lit(0))).alias("core"), (F.coalesce("h", F.lit(0)) < F.col("core")).alias("fell")), "core")
            est = new.select("id", F.col("core").cast("long").alias("core"))
            if new.where("fell").isEmpty():
                return est

    # centralities
    def degree_centrality(self) -> DataFrame:
        """(id, centrality): in- and out-degree over the other vertices' number."""
        deg = written(self.degrees(), "degrees")
        n = max(deg.count() - 1, 1)
        return deg.select("id", ((F.col("out_degree") + F.col("in_degree")) / F.lit(float(n))).alias("centrality"))

    def _sources(self, blocks: int) -> list[DataFrame]:
        """All vertices as (id), in so many parts."""
        return [self.vertices().where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b) for b in range(blocks)]

    def _all_hops(self, sources: DataFrame) -> DataFrame:
        """(source, id, hops, ways): fewest hops from these sources and how many such paths there are.  The size of the answer is that of the reachable pairs."""
        seen = written(sources.select(F.col("id").alias("source"), "id", F.lit(0).cast("long").alias("hops"), F.lit(1.0).alias("ways")), "hops")
        front, hops = seen, 0
        while not front.isEmpty():
            hops += 1
            nxt = front.join(self.edges.where("src <> dst"), F.col("id") == F.col("src")).groupBy("source", F.col("dst").alias("id")).agg(F.sum("ways").alias("ways"))
            front = written(nxt.join(seen, ["source", "id"], "left_anti").select("source", "id", F.lit(hops).cast("long").alias("hops"), "ways"), "hops")
            seen = seen.unionAll(front)
        return written(seen, "hops")

    def closeness_centrality(self, blocks: int = 1) -> DataFrame:
        """(id, centrality): vertices reached over out-edges by the sum of hops to them; 0 if none.

        A row is kept for each pair of a source and what it reaches, of one block of sources at a time.
        """
        out = None
        for part in self._sources(blocks):
            hops = self._all_hops(part)
            one = written(self._closeness(hops), "closeness", instead_of=hops)
            out = one if out is None else out.unionAll(one)
        return out

    @staticmethod
    def _closeness(hops: DataFrame) -> DataFrame:
        return hops.groupBy(F.col("source").alias("id")).agg((F.count("*") - 1).alias("n"), F.sum("hops").alias("h")).select("id", F.when(F.col("h") > 0, F.col("n") / F.col("h")).otherwise(0.0).alias("centrality"))

    def betweenness_centrality(self, blocks: int = 1, sampled: int | None = None) -> DataFrame:
        """(id, centrality): Brandes' directed, unweighted, unnormalised measure, level by level for a block of sources at a time.

        With ``sampled``, an estimate from so many sources, the same ones each time, scaled to all.
        """
        nodes, scale = written(self.vertices(), "nodes"), 1.0
        parts = self._sources(blocks)
        if sampled is not None:
            n = nodes.count()
            parts, scale = [written(nodes.orderBy(F.xxhash64("id"), "id").limit(sampled), "sample")], n / max(1, min(sampled, n))
        total = None
        for part in parts:
            one = self._between(part)
            if one is not None:
                total = one if total is None else total.unionAll(one)
        if total is None:
            return nodes.withColumn("centrality", F.lit(0.0))
        return nodes.join(total.groupBy("id").agg(F.sum("d").alias("d")), "id", "left").select("id", (F.coalesce("d", F.lit(0.0)) * scale).alias("centrality"))

    def _between(self, sources: DataFrame) -> DataFrame | None:
        """(id, d): what paths from these sources add to each vertex."""
        hops = self._all_hops(sources)
        top = hops.agg(F.max("hops").alias("m")).first()["m"] or 0
        child = hops.select("source", F.col("id").alias("w"), F.col("hops").alias("wh"), F.col("ways").alias("ww"))
        links = written(
            hops.join(self.edges.where("src <> dst"), F.col("id") == F.col("src")).select("source", F.col("id").alias("v"), "hops", "ways", F.col("dst").alias("w")).join(child, ["source", "w"]).where("wh = hops + 1").select("source", "v", "w", "hops", (F.col("ways") / F.col("ww")).alias("part")),
            "links",
        )
        total, delta = None, None
        for level in range(int(top) - 1, 0, -1):
            step = links.where(F.col("hops") == level)
            step = step.withColumn("d", F.lit(0.0)) if delta is None else step.join(delta, ["source", "w"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
            now = written(step.groupBy("source", "v").agg(F.sum(F.col("part") * (1 + F.col("d"))).alias("d")), "delta")
            delta = now.select("source", F.col("v").alias("w"), "d")
            part = now.where("source <> v").groupBy(F.col("v").alias("id")).agg(F.sum("d").alias("d"))
            total = part if total is None else total.unionAll(part)
        return None if total is None else written(total.groupBy("id").agg(F.sum("d").alias("d")), "between")

    # link prediction
    def common_neighbors(self, a: int, b: int) -> DataFrame:
        """Ids that both a and b point to."""
        return self.out_neighbors(a).intersect(self.out_neighbors(b))

    def jaccard_similarity(self, a: int, b: int) -> float:
        both = self.edges.where(F.col("src").isin(a, b)).groupBy("dst").agg(F.countDistinct("src").alias("n"))
        r = both.agg(F.count("*").alias("u"), F.coalesce(F.sum((F.col("n") == (1 if a == b else 2)).cast("int")), F.lit(0)).alias("i")).first()
        return r["i"] / r["u"] if r["u"] else 0.0

    def similar_pairs(self, least: float = 0.0) -> DataFrame:
        """(a, b, shared, jaccard) of all pairs of vertices that point to a common one, at least ``least`` alike.

        With a ``least`` above 0 only each vertex's targets of lowest in-degree meet, as many as two such
        sets must share one of (prefix filter), so that a target of many doesn't make all their pairs.
        """
        deg = self.edges.groupBy("src").count()
        meet = self.edges.select("src", "dst")
        if least > 0:
            into = self.edges.groupBy("dst").agg(F.count("*").alias("n"))
            w = Window.partitionBy("src")
            rare = meet.join(into, "dst").withColumn("r", F.row_number().over(w.orderBy("n", "dst"))).withColumn("d", F.count("*").over(w))
            rare = written(rare.where(F.col("r") <= F.col("d") - F.ceil(F.lit(least) * F.col("d") - 1e-9) + 1).select("src", "dst"), "rare")
            met = rare.select(F.col("src").alias("a"), "dst").join(rare.select(F.col("src").alias("b"), "dst"), "dst").where("a < b").select("a", "b").distinct()
            x, y = self.edges.select(F.col("src").alias("a"), "dst"), self.edges.select(F.col("src").alias("b"), "dst")
            shared = met.join(x, "a").join(y, ["b", "dst"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
            return self._jaccards(shared, deg).where(F.col("jaccard") >= least - 1e-9)
        x, y = meet.select(F.col("src").alias("a"), "dst"), meet.select(F.col("src").alias("b"), "dst")
        return self._jaccards(x.join(y, "dst").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")), deg)

    @staticmethod
    def _jaccards(shared: DataFrame, deg: DataFrame) -> DataFrame:
        da, db = deg.select(F.col("src").alias("a"), F.col("count").alias("da")), deg.select(F.col("src").alias("b"), F.col("count").alias("db"))
        return shared.join(da, "a").join(db, "b").select("a", "b", "shared", (F.col("shared") / (F.col("da") + F.col("db") - F.col("shared"))).alias("jaccard"))

    def adamic_adar(self, a: int, b: int) -> float:
        """Sum of 1 / ln(out-degree) over the shared neighbours that have out-degree above 1."""
        deg = self.edges.join(self.common_neighbors(a, b), F.col("src") == F.col("id"), "left_semi").groupBy("src").count().where("count > 1")
        return deg.agg(F.coalesce(F.sum(1 / F.log("count")), F.lit(0.0)).alias("s")).first()["s"]

    # clearing
    def eisenberg_noe(self, external: DataFrame, max_rounds: int = 1000, tolerance: float = 1e-9) -> DataFrame:
        """(id, payment, nominal, equity, defaulted) of the clearing vector; edges are debts of src to dst.

        external: (id, assets).  Payments start at what is owed and fall until no payment moves by
        the tolerance or more.  A vertex defaults if it pays less than it owes by over 1e-6.
        """
        debts = written(self.edges.where("src <> dst").withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("src"))), "debts")
        owed = debts.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("nominal"))
        base = self.vertices().join(external.select(F.col("id").cast("long").alias("id"), F.col("assets").cast("double").alias("assets")), "id", "left").join(owed, "id", "left")
        base = written(base.select("id", F.coalesce("assets", F.lit(0.0)).alias("assets"), F.coalesce("nominal", F.lit(0.0)).alias("nominal")), "banks")
        pay = base.select("id", F.col("nominal").alias("payment"))
        inflow: Column = F.coalesce("inflow", F.lit(0.0))
        for _ in range(max_rounds):
            got = pay.join(debts, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("payment") * F.col("share")).alias("inflow"))
            new = written(base.join(got, "id", "left").join(pay, "id").select("id", F.greatest(F.lit(0.0), F.least("nominal", F.col("assets") + inflow)).alias("new"), "payment"), "clearing")
            moved = new.agg(F.max(F.abs(F.col("new") - F.col("payment"))).alias("m")).first()["m"]
            pay = new.select("id", F.col("new").alias("payment"))
            if moved is None or moved < tolerance:
                break
        got = pay.join(debts, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("payment") * F.col("share")).alias("inflow"))
        return base.join(got, "id", "left").join(pay, "id").select("id", "payment", "nominal", F.greatest(F.lit(0.0), F.col("assets") + inflow - F.col("payment")).alias("equity"), (F.col("payment") + 1e-6 < F.col("nominal")).alias("defaulted"))


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("id")
    return edges.join(n.withColumnRenamed("id", "src"), "src", "left_semi").join(n.withColumnRenamed("id", "dst"), "dst", "left_semi")
