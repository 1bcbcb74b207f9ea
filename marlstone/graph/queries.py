"""Graph queries over graphs derived from the order tables, with generated SQL as their oracle.

Loops are unrolled in the oracle as materialised steps of one WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.relational import views
from .view import GraphView

PAY = "SELECT o_custkey AS src, 1000000 + l_suppkey AS dst, round(sum(l_extendedprice), 2) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey, 1000000 + l_suppkey"
FLOW = "SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, CAST(count(*) % 97 + 1 AS DOUBLE) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE (s_nationkey * 7 + c_nationkey) % 5 = 0 GROUP BY s_nationkey, c_nationkey"
SPARSE = "SELECT o_custkey AS src, (l_partkey * 31 + l_suppkey * 7) % (SELECT count(*) FROM customer) AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 20 = 5 GROUP BY 1, 2"
DENSE = "SELECT o_custkey AS src, (l_partkey * 31 + l_suppkey * 7) % (SELECT count(*) FROM customer) AS dst, CAST(1 AS DOUBLE) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey % 3 = 1 GROUP BY 1, 2"
DAG = "SELECT src, dst, weight FROM (" + SPARSE + ") q WHERE src < dst"


def _graph(sql: str):
    def of(spark: SparkSession, sf_dir: str) -> GraphView:
        views(spark, sf_dir, sql)
        return GraphView.frozen(spark.sql(sql))

    return of


pay, flow, sparse, dense, dag = map(_graph, (PAY, FLOW, SPARSE, DENSE, DAG))


def g_counts(spark, d) -> DataFrame:
    g = pay(spark, d)
    return g.vertices().agg(F.count("*").alias("nodes")).crossJoin(g.edges.agg(F.count("*").alias("edges")))


def g_degrees(spark, d) -> DataFrame:
    return pay(spark, d).degrees()


def g_out_neighbors(spark, d) -> DataFrame:
    return pay(spark, d).out_neighbors(7)


def g_in_neighbors(spark, d) -> DataFrame:
    return pay(spark, d).in_neighbors(1000003)


def g_bfs(spark, d) -> DataFrame:
    return sparse(spark, d).bfs(5)


def g_shortest_path_length(spark, d) -> DataFrame:
    path = flow(spark, d).shortest_path(3, 11)
    return spark.createDataFrame([(len(path) - 1 if path else None,)], "hops long")


def g_dijkstra(spark, d) -> DataFrame:
    return flow(spark, d).dijkstra(3)


def g_weighted_path_cost(spark, d) -> DataFrame:
    got = flow(spark, d).weighted_shortest_path(3, 11)
    return spark.createDataFrame([(got[1] if got else None,)], "cost double")


def g_topological_levels(spark, d) -> DataFrame:
    return dag(spark, d).topological_order()


def g_pagerank20(spark, d) -> DataFrame:
    return pay(spark, d).pagerank(20, 0.85).select("id", F.round("rank", 9).alias("rank"))


def g_ppr40(spark, d) -> DataFrame:
    return flow(spark, d).personalized_pagerank([3, 5], 40, 0.85).select("id", F.round("rank", 9).alias("rank"))


def g_wcc(spark, d) -> DataFrame:
    return sparse(spark, d).connected_components()


def g_scc(spark, d) -> DataFrame:
    return sparse(spark, d).strongly_connected_components()


def g_cycles(spark, d) -> DataFrame:
    return sparse(spark, d).laundering_cycles()


def g_triangles(spark, d) -> DataFrame:
    return dense(spark, d).triangle_count()


def g_degree_centrality(spark, d) -> DataFrame:
    return pay(spark, d).degree_centrality().select("id", F.round("centrality", 9).alias("centrality"))


def g_closeness(spark, d) -> DataFrame:
    return flow(spark, d).closeness_centrality().select("id", F.round("centrality", 9).alias("centrality"))


def g_betweenness(spark, d) -> DataFrame:
    return flow(spark, d).betweenness_centrality().select("id", F.round("centrality", 6).alias("centrality"))


def g_label_propagation(spark, d) -> DataFrame:
    return flow(spark, d).label_propagation()


def g_kcore(spark, d) -> DataFrame:
    return flow(spark, d).k_core()


def g_common_neighbors(spark, d) -> DataFrame:
    return pay(spark, d).common_neighbors(7, 10)


def g_similar_pairs(spark, d) -> DataFrame:
    return flow(spark, d).similar_pairs().select("a", "b", "shared", F.round("jaccard", 9).alias("jaccard"))


def g_jaccard(spark, d) -> DataFrame:
    return spark.createDataFrame([(round(flow(spark, d).jaccard_similarity(3, 8), 9),)], "jaccard double")


def g_adamic_adar(spark, d) -> DataFrame:
    return spark.createDataFrame([(round(flow(spark, d).adamic_adar(3, 8), 9),)], "score double")


def g_recommend(spark, d) -> DataFrame:
    return flow(spark, d).recommend(3, 5).select("id", F.round("score", 9).alias("score"))


def g_eisenberg_noe(spark, d) -> DataFrame:
    g = flow(spark, d)
    return g.eisenberg_noe(g.vertices().select("id", (F.col("id") % 7 * 10.0).alias("assets"))).select("id", F.round("payment", 5).alias("payment"), F.round("equity", 5).alias("equity"), "defaulted")


QUERIES = {f.__name__: f for f in (
    g_counts, g_degrees, g_out_neighbors, g_in_neighbors, g_bfs, g_shortest_path_length, g_dijkstra, g_weighted_path_cost, g_topological_levels,
    g_pagerank20, g_ppr40, g_wcc, g_scc, g_cycles, g_triangles, g_degree_centrality, g_closeness, g_betweenness, g_label_propagation,
    g_kcore, g_common_neighbors, g_similar_pairs, g_jaccard, g_adamic_adar, g_recommend, g_eisenberg_noe,
)}


def _with(edges: str, *steps: tuple[str, str]) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS {'' if 'RECURSION' in q else 'MATERIALIZED '}({q.replace('RECURSION', '')})" for n, q in (("e", edges), ("v", "SELECT src AS id FROM e UNION SELECT dst FROM e"), *steps))


def _ranks(base: str, steps: int, d: float) -> list[tuple[str, str]]:
    out = [("od", "SELECT src, count(*) AS n FROM e GROUP BY src"), ("b", base), ("r0", "SELECT id, base AS rank FROM b")]
    for i in range(steps):
        out.append((f"r{i + 1}", f"SELECT b.id, b.base * {1 - d} + {d} * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM od)) * b.base) AS rank FROM b LEFT JOIN (SELECT e.dst, sum(r.rank / od.n) AS got FROM e JOIN od ON e.src = od.src JOIN r{i} r ON r.id = e.src GROUP BY e.dst) g ON g.dst = b.id"))
    return out


def _relax(source: int, steps: int, cost: str) -> list[tuple[str, str]]:
    out = [("d0", f"SELECT id, CAST(0 AS DOUBLE) AS cost FROM v WHERE id = {source}")]
    for i in range(steps):
        out.append((f"d{i + 1}", f"SELECT id, min(cost) AS cost FROM (SELECT * FROM d{i} UNION ALL SELECT e.dst, d.cost + {cost} FROM d{i} d JOIN e ON e.src = d.id) GROUP BY id"))
    return out


_REACH = ("reach", "RECURSIONSELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM reach r JOIN e ON e.src = r.b")
_SCC = ("scc", "SELECT v.id, least(v.id, coalesce((SELECT min(x.b) FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a = v.id), v.id)) AS component FROM v")
_LEVELS = ("lv", "RECURSIONSELECT id, CAST(0 AS BIGINT) AS level FROM v UNION SELECT e.dst, l.level + 1 FROM lv l JOIN e ON e.src = l.id")
_PPR = "SELECT id, CASE WHEN id IN (3, 5) THEN 1.0 / (SELECT count(*) FROM v WHERE id IN (3, 5)) ELSE 0.0 END AS base FROM v"
_REC = "SELECT id, CASE WHEN id = 3 THEN 1.0 ELSE 0.0 END AS base FROM v"


def _hops(limit: int) -> tuple[str, str]:
    return ("h", f"RECURSIONSELECT id AS source, id, CAST(0 AS BIGINT) AS hops FROM v UNION SELECT h.source, e.dst, h.hops + 1 FROM h JOIN e ON e.src = h.id WHERE h.hops < {limit}")


def _labels(steps: int) -> list[tuple[str, str]]:
    out = [("l0", "SELECT id, id AS m FROM v")]
    for i in range(steps):
        out.append((f"l{i + 1}", f"SELECT id, min(m) AS m FROM (SELECT * FROM l{i} UNION ALL SELECT e.dst, l.m FROM e JOIN l{i} l ON l.id = e.src UNION ALL SELECT e.src, l.m FROM e JOIN l{i} l ON l.id = e.dst) GROUP BY id"))
    return out


def _paths(limit: int) -> list[tuple[str, str]]:
    """(source, id, hops, ways): fewest hops and the number of such paths, level by level."""
    out = [("p0", "SELECT id AS source, id, CAST(0 AS BIGINT) AS hops, CAST(1 AS DOUBLE) AS ways FROM v"), ("a0", "SELECT * FROM p0")]
    for i in range(limit):
        out.append((f"p{i + 1}", f"SELECT p.source, e.dst AS id, CAST({i + 1} AS BIGINT) AS hops, sum(p.ways) AS ways FROM p{i} p JOIN e ON e.src = p.id AND e.src <> e.dst WHERE NOT EXISTS (SELECT 1 FROM a{i} a WHERE a.source = p.source AND a.id = e.dst) GROUP BY p.source, e.dst"))
        out.append((f"a{i + 1}", f"SELECT * FROM a{i} UNION ALL SELECT * FROM p{i + 1}"))
    return out


def _cores(steps: int) -> list[tuple[str, str]]:
    """Estimates fall to the h-index of the neighbours'."""
    out = [("u", "SELECT src AS id, dst AS nb FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst"), ("c0", "SELECT v.id, (SELECT count(*) FROM u WHERE u.id = v.id) AS core FROM v")]
    for i in range(steps):
        out.append((f"q{i + 1}", f"SELECT u.id, c.core, row_number() OVER (PARTITION BY u.id ORDER BY c.core DESC) AS r FROM u JOIN c{i} c ON c.id = u.nb"))
        out.append((f"c{i + 1}", f"SELECT c.id, least(c.core, coalesce((SELECT max(least(q.r, q.core)) FROM q{i + 1} q WHERE q.id = c.id), 0)) AS core FROM c{i} c"))
    return out


def _clearing(steps: int) -> list[tuple[str, str]]:
    out = [
        ("owed", "SELECT src AS id, sum(weight) AS nominal FROM e WHERE src <> dst GROUP BY src"),
        ("bank", "SELECT v.id, v.id % 7 * 10.0 AS assets, coalesce(owed.nominal, 0) AS nominal FROM v LEFT JOIN owed ON owed.id = v.id"),
        ("y0", "SELECT id, nominal AS pay FROM bank"),
    ]
    for i in range(steps):
        out.append((f"y{i + 1}", f"SELECT b.id, greatest(0.0, least(b.nominal, b.assets + coalesce((SELECT sum(y.pay * e.weight / o.nominal) FROM e JOIN y{i} y ON y.id = e.src JOIN owed o ON o.id = e.src WHERE e.dst = b.id AND e.src <> e.dst), 0))) AS pay FROM bank b"))
    return out


def _in_turn(rounds: int) -> list[tuple[str, str]]:
    """Labels of all vertices as a list; each step updates one vertex, in order of ids."""
    return [
        ("ix", "SELECT id, row_number() OVER (ORDER BY id) AS i FROM v"),
        ("nb", "SELECT a.i AS x, b.i AS y FROM e JOIN ix a ON a.id = e.src JOIN ix b ON b.id = e.dst UNION ALL SELECT b.i, a.i FROM e JOIN ix a ON a.id = e.src JOIN ix b ON b.id = e.dst"),
        ("near", "SELECT x, list(y) AS ys FROM nb GROUP BY x"),
        ("lp", f"RECURSIONSELECT CAST(0 AS BIGINT) AS step, (SELECT list(i - 1 ORDER BY i) FROM ix) AS ls UNION ALL SELECT step + 1, list_transform(range(1, len(ls) + 1), lambda j: CASE WHEN j = n.x THEN (list_sort(list_transform(list_distinct(list_transform(n.ys, lambda y: ls[y])), lambda l: struct_pack(c := -len(list_filter(n.ys, lambda y: ls[y] = l)), l := l))))[1].l ELSE ls[j] END) FROM lp JOIN near n ON n.x = step % (SELECT count(*) FROM ix) + 1 WHERE step < {rounds} * (SELECT count(*) FROM ix)"),
    ]


ORACLES = {
    "g_betweenness": _with(FLOW, *_paths(8)) + " SELECT v.id, round(coalesce((SELECT sum(x.ways * y.ways / z.ways) FROM a8 x JOIN a8 y ON x.id = y.source JOIN a8 z ON z.source = x.source AND z.id = y.id WHERE x.id = v.id AND x.source <> v.id AND y.id <> v.id AND x.source <> y.id AND x.hops + y.hops = z.hops), 0.0), 6) AS centrality FROM v",
    "g_kcore": _with(FLOW, *_cores(12)) + " SELECT id, CAST(core AS BIGINT) AS core FROM c12",
    "g_label_propagation": _with(FLOW, *_in_turn(10)) + " SELECT ix.id, (SELECT arg_max(ls, step) FROM lp)[ix.i] AS label FROM ix",
    "g_eisenberg_noe": _with(FLOW, *_clearing(60)) + " SELECT b.id, round(y.pay, 5) AS payment, round(greatest(0.0, b.assets + coalesce((SELECT sum(z.pay * e.weight / o.nominal) FROM e JOIN y60 z ON z.id = e.src JOIN owed o ON o.id = e.src WHERE e.dst = b.id AND e.src <> e.dst), 0) - y.pay), 5) AS equity, y.pay + 1e-6 < b.nominal AS defaulted FROM bank b JOIN y60 y ON y.id = b.id",
    "g_counts": _with(PAY) + " SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges",
    "g_degrees": _with(PAY) + " SELECT id, (SELECT count(*) FROM e WHERE src = id) AS out_degree, (SELECT count(*) FROM e WHERE dst = id) AS in_degree FROM v",
    "g_out_neighbors": _with(PAY) + " SELECT dst AS id FROM e WHERE src = 7",
    "g_in_neighbors": _with(PAY) + " SELECT src AS id FROM e WHERE dst = 1000003",
    "g_bfs": _with(SPARSE, *_relax(5, 40, "1")) + " SELECT id, CAST(cost AS BIGINT) AS hops FROM d40",
    "g_shortest_path_length": _with(FLOW, *_relax(3, 25, "1")) + " SELECT (SELECT CAST(cost AS BIGINT) FROM d25 WHERE id = 11) AS hops",
    "g_dijkstra": _with(FLOW, *_relax(3, 25, "greatest(e.weight, 0)")) + " SELECT id, cost FROM d25",
    "g_weighted_path_cost": _with(FLOW, *_relax(3, 25, "greatest(e.weight, 0)")) + " SELECT (SELECT cost FROM d25 WHERE id = 11) AS cost",
    "g_topological_levels": _with(DAG, _LEVELS) + " SELECT id, max(level) AS level FROM lv GROUP BY id",
    "g_pagerank20": _with(PAY, *_ranks("SELECT id, 1.0 / (SELECT count(*) FROM v) AS base FROM v", 20, 0.85)) + " SELECT id, round(rank, 9) AS rank FROM r20",
    "g_ppr40": _with(FLOW, *_ranks(_PPR, 40, 0.85)) + " SELECT id, round(rank, 9) AS rank FROM r40",
    "g_wcc": _with(SPARSE, *_labels(40)) + " SELECT id, dense_rank() OVER (ORDER BY m) - 1 AS component FROM l40",
    "g_scc": _with(SPARSE, _REACH, _SCC) + " SELECT id, component FROM scc",
    "g_cycles": _with(SPARSE, _REACH, _SCC) + " SELECT component, list_sort(list(id)) AS members FROM scc GROUP BY component HAVING count(*) >= 2",
    "g_triangles": _with(DENSE, ("u", "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst")) + " SELECT count(*) AS triangles FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b",
    "g_degree_centrality": _with(PAY) + " SELECT id, round(((SELECT count(*) FROM e WHERE src = id) + (SELECT count(*) FROM e WHERE dst = id)) / CAST(greatest((SELECT count(*) FROM v) - 1, 1) AS DOUBLE), 9) AS centrality FROM v",
    "g_closeness": _with(FLOW, _hops(12), ("m", "SELECT source, id, min(hops) AS hops FROM h GROUP BY source, id")) + " SELECT source AS id, round(CASE WHEN sum(hops) > 0 THEN (count(*) - 1) / CAST(sum(hops) AS DOUBLE) ELSE 0.0 END, 9) AS centrality FROM m GROUP BY source",
    "g_common_neighbors": _with(PAY) + " SELECT dst AS id FROM e WHERE src = 7 INTERSECT SELECT dst FROM e WHERE src = 10",
    "g_similar_pairs": _with(FLOW, ("dg", "SELECT src, count(*) AS n FROM e GROUP BY src"), ("p", "SELECT x.src AS a, y.src AS b, count(*) AS shared FROM e x JOIN e y ON x.dst = y.dst AND x.src < y.src GROUP BY x.src, y.src")) + " SELECT a, b, shared, round(shared / CAST(da.n + db.n - shared AS DOUBLE), 9) AS jaccard FROM p JOIN dg da ON da.src = a JOIN dg db ON db.src = b",
    "g_jaccard": _with(FLOW) + " SELECT round(coalesce((SELECT count(*) FROM (SELECT dst FROM e WHERE src = 3 INTERSECT SELECT dst FROM e WHERE src = 8)) / nullif(CAST((SELECT count(DISTINCT dst) FROM e WHERE src IN (3, 8)) AS DOUBLE), 0), 0.0), 9) AS jaccard",
    "g_adamic_adar": _with(FLOW) + " SELECT round(coalesce(sum(1 / ln(n)), 0.0), 9) AS score FROM (SELECT src, count(*) AS n FROM e WHERE src IN (SELECT dst FROM e WHERE src = 3 INTERSECT SELECT dst FROM e WHERE src = 8) GROUP BY src HAVING count(*) > 1)",
    "g_recommend": _with(FLOW, *_ranks(_REC, 40, 0.85)) + " SELECT id, round(rank, 9) AS score FROM r40 WHERE rank > 0 AND id <> 3 AND id NOT IN (SELECT dst FROM e WHERE src = 3) ORDER BY rank DESC, id LIMIT 5",
}
