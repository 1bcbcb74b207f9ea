import math

import pytest
from compare import same_rows

from marlstone.graph import queries
from marlstone.graph.components import connected_components
from marlstone.graph.view import GraphView

SAMPLE = [(1, 2), (2, 3), (3, 4), (1, 3), (4, 1), (5, 6)]


@pytest.fixture
def graph(spark):
    def make(edges):
        rows = [(e[0], e[1], float(e[2]) if len(e) > 2 and e[2] is not None else None) for e in edges]
        return GraphView(spark.createDataFrame(rows, "src long, dst long, weight double"))

    return make


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


FAST = ("g_counts", "g_degrees", "g_out_neighbors", "g_in_neighbors", "g_triangles", "g_degree_centrality", "g_common_neighbors", "g_similar_pairs", "g_jaccard", "g_adamic_adar", "g_topological_levels", "g_wcc", "g_scc", "g_dijkstra", "g_closeness")


@pytest.mark.parametrize("name", FAST)
def test_agrees_with_sql(spark, sf, duck, name):
    same_rows(queries.QUERIES[name](spark, sf), duck, queries.ORACLES[name])


def test_sample(graph):
    g = graph(SAMPLE)
    assert (g.node_count(), g.edge_count()) == (6, 6)
    assert pairs(g.bfs(1)) == {1: 0, 2: 1, 3: 1, 4: 2}
    assert g.shortest_path(1, 4) == [1, 3, 4]
    assert g.shortest_path(1, 5) is None and g.shortest_path(3, 3) == [3] and g.shortest_path(9, 9) is None
    assert pairs(g.connected_components()) == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1}
    assert pairs(g.bfs(77)) == {}


def test_pagerank_finds_the_hub_and_sums_to_one(graph):
    rank = pairs(graph([(2, 1), (3, 1), (4, 1), (5, 1)]).pagerank())
    assert max(rank, key=rank.get) == 1 and abs(sum(rank.values()) - 1) < 1e-6


def test_personalized_rank_falls_along_a_chain(graph):
    g = graph([(1, 2), (2, 3), (3, 4)])
    r = pairs(g.personalized_pagerank([1]))
    assert r[1] > r[2] > r[3] > r[4]
    assert g.personalized_pagerank([99]).count() == 0


def test_triangle_and_tail(graph):
    g = graph([(1, 2), (2, 3), (3, 1), (3, 4)])
    assert g.triangle_count().first()[0] == 1
    assert [r["members"] for r in g.laundering_cycles().collect()] == [[1, 2, 3]]
    core = pairs(g.k_core())
    assert core[1] == 2 and core[4] == 1


def test_dag(graph):
    g = graph([(1, 2), (2, 3), (1, 3)])
    assert g.laundering_cycles().count() == 0
    assert [r["id"] for r in g.topological_order().collect()] == [1, 2, 3]
    assert graph([(1, 2), (2, 1)]).topological_order() is None


def test_weights(graph):
    g = graph([(1, 2, 1), (2, 4, 1), (1, 4, 5)])
    assert pairs(g.dijkstra(1))[4] == 2.0
    assert g.weighted_shortest_path(1, 4) == ([1, 2, 4], 2.0)
    assert g.weighted_shortest_path(4, 1) is None
    assert pairs(graph([(1, 2, -3), (2, 3, None)]).dijkstra(1)) == {1: 0.0, 2: 0.0, 3: 1.0}


def test_star_both_ways(graph):
    g = graph([(1, n) for n in range(2, 6)] + [(n, 1) for n in range(2, 6)])
    between, close = pairs(g.betweenness_centrality()), pairs(g.closeness_centrality())
    assert between == {1: 12.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0}
    assert close[1] >= close[2]
    assert len(set(pairs(g.label_propagation()).values())) <= 2


def test_betweenness_counts_shared_paths(graph):
    # two shortest ways from 1 to 4
    b = pairs(graph([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)]).betweenness_centrality())
    assert b == {1: 0.0, 2: 1.0, 3: 1.0, 4: 3.0, 5: 0.0}


def test_overlap(graph):
    g = graph([(1, 3), (2, 3), (1, 9)])
    assert [r[0] for r in g.common_neighbors(1, 2).collect()] == [3]
    assert g.jaccard_similarity(1, 2) == 0.5 and g.jaccard_similarity(1, 1) == 1.0 and g.jaccard_similarity(7, 8) == 0.0


def test_bipartite(graph):
    likes = [(1, 100), (1, 101), (1, 102), (2, 100), (2, 101), (2, 102), (3, 100), (3, 101), (3, 102), (4, 100), (4, 101), (5, 200)]
    g = graph(likes + [(b, a) for a, b in likes])
    got = {r["id"] for r in g.recommend(4, 10).collect()}
    assert 102 in got and not got & {100, 101, 4, 200}
    assert g.adamic_adar(100, 102) == pytest.approx(3 / math.log(3)) and g.adamic_adar(100, 200) == 0


def test_clearing(graph, spark):
    g = graph([(1, 2, 100), (2, 3, 100)])
    got = {r["id"]: r for r in g.eisenberg_noe(spark.createDataFrame([(1, 60.0)], "id long, assets double")).collect()}
    assert got[1]["payment"] == got[2]["payment"] == 60 and got[3]["equity"] == 60
    assert {i for i, r in got.items() if r["defaulted"]} == {1, 2}
    fine = g.eisenberg_noe(spark.createDataFrame([(1, 100.0)], "id long, assets double"))
    assert fine.where("defaulted").count() == 0


def test_components_of_long_chains_and_loops(spark):
    rows = [(i, i + 1) for i in range(60)] + [(100, 100), (None, 5)]
    got = pairs(connected_components(spark.createDataFrame(rows, "src long, dst long")))
    assert got == {i: 0 for i in range(61)} | {100: 100}


def test_store_is_upserted_and_views_are_snapshots(engine):
    from marlstone.graph.store import GraphStore

    s = GraphStore(engine.db, "g")
    s.add_edges([(1, 2), (2, 3), (1, 2, 5.0)])
    before = s.view()
    s.add_edge(3, 1)
    assert before.edge_count() == 2 and s.view().edge_count() == 3
    assert {(r["src"], r["weight"]) for r in before.edges.collect()} == {(1, 5.0), (2, 1.0)}
    assert [r[0] for r in s.out_neighbors(1).collect()] == [2]


def test_label_rounds_and_filtered_pairs(spark):
    import itertools

    from marlstone.graph.view import GraphView

    two = [(a, b, 1.0) for group in ((1, 2, 3, 4), (11, 12, 13, 14)) for a, b in itertools.permutations(group, 2)] + [(4, 11, 1.0)]
    g = GraphView(spark.createDataFrame(two, "src long, dst long, weight double"))
    labels = {r["id"]: r["label"] for r in g.label_rounds().collect()}
    assert {labels[i] for i in (1, 2, 3, 4)} == {1} and {labels[i] for i in (11, 12, 13, 14)} == {11}
    every = {(r["a"], r["b"], r["shared"], r["jaccard"]) for r in g.similar_pairs().collect()}
    for least in (0.3, 0.5, 0.9):
        assert {tuple(r) for r in g.similar_pairs(least).collect()} == {x for x in every if x[3] >= least - 1e-9}


def test_blocks_of_sources_change_nothing(spark):
    from marlstone.graph.view import GraphView

    g = GraphView(spark.createDataFrame([(i % 7, i * i % 11, 1.0) for i in range(20)], "src long, dst long, weight double").distinct())
    near = lambda df: {r["id"]: round(r["centrality"], 9) for r in df.collect()}
    assert near(g.closeness_centrality(3)) == near(g.closeness_centrality())
    whole = near(g.betweenness_centrality())
    assert near(g.betweenness_centrality(3)) == whole == near(g.betweenness_centrality(sampled=1000)) and max(whole.values()) > 0


def test_ranks_equal_plain_steps_and_leave_out_what_nothing_points_to(graph, monkeypatch):
    from marlstone.graph import view

    rows, real = {}, view.written

    def noted(df, what, **how):
        out = real(df, what, **how)
        rows[what] = out.count()
        return out

    monkeypatch.setattr(view, "written", noted)
    # 1 and 2 are only sources, 6 is an end, 5 has a loop
    edges = [(1, 3), (1, 6), (2, 3), (3, 4), (4, 3), (4, 5), (5, 5), (5, 6)]
    rank = {v: 1 / 6 for v in range(1, 7)}
    for _ in range(7):
        new = {v: 0.15 / 6 + 0.85 * rank[6] / 6 for v in rank}
        for a, b in edges:
            new[b] += 0.85 * rank[a] / sum(x == a for x, _ in edges)
        rank = new
    got = pairs(graph(edges).pagerank(7))
    assert got.keys() == rank.keys() and all(math.isclose(got[v], rank[v]) for v in rank) and rows["shares"] == 5
    pairs(graph([(1, 11), (2, 11), (2, 12)]).pagerank(2))
    assert rows["shares"] == 0
