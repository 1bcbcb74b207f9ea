"""URL filters and nearest neighbours."""

import fnmatch
import random
import re

import numpy as np
import pyarrow as pa
from compare import same_rows

from marlstone.llm import ann, urlfilter
from marlstone.llm import textkernel as K
from marlstone.llm.queries import ORACLES, QUERIES


def test_urls_agree_with_sql(spark, sf, duck):
    same_rows(QUERIES["op3_url_filter"](spark, sf), duck, ORACLES["op3_url_filter"])


def test_automaton_equals_backtracking():
    r = random.Random(2)
    globs = ["".join(r.choice("ab*?c") for _ in range(r.randrange(0, 9))) for _ in range(200)]
    texts = ["".join(r.choice("abc") for _ in range(r.randrange(0, 14))) for _ in range(300)]
    got = urlfilter.Automaton(globs).match(*K.text_buffers(pa.array(texts)))
    want = np.array([[re.fullmatch(fnmatch.translate(g), t) is not None for g in globs] for t in texts])
    assert (got == want).all()


def test_canonical_form(spark):
    rows = {
        "HTTPS://www.Example.com:443/a/?utm_source=x&b=1#top": "example.com/a/?b=1", "http://x.org/": "x.org", " http://x.org/p?ref=1 ": "x.org/p",
        "http://x.org:8080/q?a=1&&b=2": "x.org:8080/q?a=1&b=2", "": "",
    }
    df = spark.createDataFrame([(k,) for k in rows], "u string")
    assert {r[0]: r[1] for r in df.select("u", urlfilter.canonical(df["u"])).collect()} == rows


def test_urls_in_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "http://casino.example/"), (3, "http://casino.example/"), (None, "y" * 20_000 + "casino")]
    df = spark.createDataFrame([(a, b, "h", "clash") for a, b in rows], "page_id long, url string, html string, rules string")
    got = [(r["page_id"], r["rules"], r["blocked"]) for r in urlfilter.check(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, [], False), (2, [], False), (3, ["casino"], True), (3, ["casino"], True), (None, ["casino"], True)], key=repr)
    assert urlfilter.check(df.limit(0)).count() == 0
    assert [r["rules"] for r in urlfilter.check(df.where("page_id = 3"), []).collect()] == [[], []]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def recall(df, got, k=10):
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    ids, v = np.array([a for a, _ in rows]), np.array([b for _, b in rows])
    d = ((v[:, None] - v[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    true = {int(i): set(ids[np.argsort(d[j])[:k]].tolist()) for j, i in enumerate(ids)}
    return np.mean([r["neighbor_id"] in true[r["vec_id"]] for r in got])


def test_recall_over_shards(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = ann.neighbours(df, shard_rows=150, query_rows=200).collect()
    assert len(got) == 10 * df.count() and recall(df, got) >= 0.9
    assert all(r["vec_id"] != r["neighbor_id"] for r in got)


def test_recall_of_the_query_itself(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = QUERIES["op4_nearest_neighbours"](spark, sf).collect()
    # the rows whose id is divisible by 50 are the queries, against all rows
    assert {r["vec_id"] for r in got} == {r["vec_id"] for r in df.where("vec_id % 50 = 0").collect()}
    assert len(got) == 10 * df.where("vec_id % 50 = 0").count() and recall(df, got) == 1


def test_a_scan_equals_brute_force(spark):
    r = np.random.default_rng(7)
    # a coarse grid, far from 0: equal vectors, equal distances, and products that lose digits
    v = r.integers(0, 4, (400, 3)).astype(np.float32) + 1000
    table = vectors(spark, [(i, [float(c) for c in x], 0) for i, x in enumerate(v)])
    got = {}
    for x in ann.nearest(table, k=7, every=20, least_bytes=1200).orderBy("vec_id", "rank").collect():
        got.setdefault(x["vec_id"], []).append((x["distance"], x["neighbor_id"]))
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)).astype(np.float64)
    assert got == {i: sorted((float(d[i, j]), j) for j in range(400) if j != i)[:7] for i in range(0, 400, 20)}
    odd = [*((i, [1.0, 1.0], 0) for i in range(30)), (100, [5.0, 5.0], 0), (100, [5.0, 5.0], 0), (101, None, 0), (None, [1.0, 1.0], 0), (103, [float("nan"), 1.0], 0), (102, [1.0], 0), (105, [2.0], 0)]
    same = lambda df: sorted(tuple(x) for x in df.collect())
    assert same(ann.nearest(vectors(spark, odd), k=3, every=1)) == same(ann.neighbours(vectors(spark, odd), k=3))
    assert ann.nearest(vectors(spark, [])).count() == 0


def test_a_search_wider_than_the_graph_ends_and_finds_all():
    v = np.random.default_rng(4).normal(size=(90, 8)).astype(np.float32)
    q = np.random.default_rng(5).normal(size=(40, 8)).astype(np.float32)
    ids, dist = ann.Hnsw(v).search(q, 90, 300)
    assert all(sorted(row) == list(range(90)) for row in ids.tolist()) and (np.diff(dist, axis=1) >= 0).all()


def test_graph_recall():
    v = np.random.default_rng(1).normal(size=(3000, 16)).astype(np.float32)
    g = ann.Hnsw(v)
    ids, _ = g.search(v[:300], 10, 100)
    d = ((v[:300, None] - v[None]) ** 2).sum(-1)
    true = np.argsort(d, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(ids, true, strict=True)]) >= 0.9
    assert g.links[0].shape[1] == 32 and g.links[0].dtype == np.int32


def test_vectors_in_edge_cases(spark):
    same = [(i, [1.0, 1.0], 0) for i in range(30)]
    rows = [*same, (100, [5.0, 5.0], 0), (100, [5.0, 5.0], 0), (101, None, 0), (None, [1.0, 1.0], 0), (102, [1.0], 0), (103, [float("nan"), 1.0], 0), (104, [1.0, None], 0)]
    got = ann.neighbours(vectors(spark, rows), k=3).collect()
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append((r["rank"], r["neighbor_id"], r["distance"]))
    # a vector of another length is searched among its like only
    assert set(by) == {*range(30), 100}
    two = vectors(spark, [*rows, (105, [2.0], 0), (106, [float(i) for i in range(3)], 0)])
    lone = {(r["vec_id"], r["neighbor_id"]) for r in ann.neighbours(two, k=3).where("vec_id in (102, 105, 106)").collect()}
    assert lone == {(102, 105), (105, 102)}
    clash = two.selectExpr("*", "1 AS id", "2 AS v", "3 AS shard", "4 AS size", "5 AS slice")
    assert ann.neighbours(clash, k=3).count() == ann.neighbours(two, k=3).count()
    assert sorted(by[0]) == [(1, 1, 0.0), (2, 2, 0.0), (3, 3, 0.0)] and sorted(by[100])[0][1] == 0
    assert ann.neighbours(vectors(spark, [])).count() == 0 and ann.neighbours(vectors(spark, [(1, [1.0], 0)])).count() == 0
