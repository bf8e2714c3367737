"""Exact, cell-partitioned, compressed and graph search."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.errors import DimensionMismatch, EmptyIndex, InvalidConfig, SearchUnfinished
from vecloom.functions import vectors as V
from vecloom.operators import clusters, compress, graph, knn
from vecloom.sources.scratch import kept


def table(spark, v, name="key", column="vector", first=0):
    return spark.createDataFrame([(n + first, x.tolist()) for n, x in enumerate(v)], f"{name} long, {column} array<double>")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=(400, 12)) * rng.uniform(0.5, 3, (400, 1))
    v[5] = v[9] = v[11]  # ties
    v[17] = 0
    return v, table(spark, v).repartition(5).cache(), table(spark, v[::40], "qid", "q").cache()


def truth(v, q, k, metric):
    d = knn.exact(np.repeat(q, len(v), axis=0), np.tile(v, (len(q), 1)), metric).reshape(len(q), -1)
    return [[(int(i), d[n, i]) for i in np.lexsort((np.arange(len(v)), d[n]))[:k]] for n in range(len(q))]


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r.rank)):
        out.setdefault(r.qid, []).append((r.key, r.distance))
    return [out[k] for k in sorted(out)]


@pytest.mark.parametrize("metric", ["l2_sq", "cosine", "inner_product", "euclidean"])
@pytest.mark.parametrize("k", [1, 4, 1000])
def test_knn(data, metric, k):
    v, base, queries = data
    want, got = truth(v, v[::40], k, metric), answers(knn.knn(queries, base, k, metric))
    assert [[a for a, _ in x] for x in got] == [[a for a, _ in x] for x in want]
    assert np.allclose([d for x in got for _, d in x], [d for x in want for _, d in x])
    if k == 4:
        assert np.allclose([d for x in answers(knn.knn_expr(queries, base, k, metric)) for _, d in x], [d for x in want for _, d in x])


def test_knn_blocks_filters_and_edges(spark, data, monkeypatch):
    v, base, queries = data
    want = answers(knn.knn(queries, base, 3))
    monkeypatch.setattr(knn, "QUERY_BYTES", 200)
    monkeypatch.setattr(knn, "CELL_BYTES", 1000)
    assert answers(knn.knn(queries, base, 3)) == want
    monkeypatch.undo()
    dead = base.where("key % 3 = 0").select("key")
    got = knn.knn(queries, base, 5, where=F.col("key") % 2 == 0, tombstones=dead)
    keep = [i for i in range(400) if i % 2 == 0 and i % 3]
    assert [[a for a, _ in x] for x in answers(got)] == [[keep[a] for a, _ in x] for x in truth(v[keep], v[::40], 5, "l2_sq")]
    assert knn.knn(queries, base, 0).count() == knn.knn(queries, base.limit(0), 3).count() == knn.knn(queries.limit(0), base, 3).count() == 0
    assert knn.knn(queries, base, 5, tombstones=base.select("key")).count() == 0
    with pytest.raises(Exception, match="elements|DimensionMismatch"):
        knn.knn(queries, table(spark, np.ones((2, 5))), 1).collect()
    with pytest.raises(DimensionMismatch):
        knn.matrix(pa.array([[1.0], [1.0, 2.0]]))


def test_string_keys_and_many_equal_vectors(spark):
    base = spark.createDataFrame([(f"k{n:03}", [1.0, 2.0]) for n in range(300)], "key string, vector array<double>").repartition(6)
    q = spark.createDataFrame([(1, [0.0, 0.0])], "qid long, q array<double>")
    assert [r.key for r in knn.knn(q, base, 3).orderBy("rank").collect()] == ["k000", "k001", "k002"]


def test_custom_metric(data):
    _, base, queries = data
    V.register_metric("l1", lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x))
    r = knn.knn(queries, base, 1, "l1").collect()
    assert all(x.distance == 0 for x in r)


def test_radius_truth_recall_sample(data):
    v, base, queries = data
    got = {(r.qid, r.key) for r in knn.within(queries, base, 20.0).collect()}
    assert got == {(n, i) for n, q in enumerate(v[::40]) for i, d in enumerate(((v - q) ** 2).sum(axis=1)) if d <= 20.0}
    t = knn.ground_truth(queries, base, 3, normalise=True).collect()
    assert len(t) == 10 and all(len(r["keys"]) == 3 for r in t)
    a, b = knn.knn(queries, base, 4), knn.knn(queries, base, 2)
    assert knn.recall(a, b).first().recall == 50.0 and knn.recall(a.limit(0), b).first().recall is None
    s = knn.sample(base.select("key"), 20, 1)
    assert s.count() == 20 and sorted(s.collect()) == sorted(knn.sample(base.select("key").repartition(3), 20, 1).collect())


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_running_top_k(drawn):
    """The partition operator against sorting everything, for any batches, ties and bounds."""
    n, k = drawn.draw(st.integers(0, 60)), drawn.draw(st.integers(0, 9))
    v = np.array(drawn.draw(st.lists(st.lists(st.integers(-2, 2), min_size=3, max_size=3), min_size=n, max_size=n)), np.float64).reshape(n, 3)
    q = np.array([[0.0, 1, 2], [1, 1, 1]])
    keys = np.random.default_rng(n).permutation(n)
    top = knn.TopK(q, k, "l2_sq")
    for at in range(0, n, 7):
        top.add(keys[at : at + 7], v[at : at + 7])
    for i in range(2):
        d = ((v - q[i]) ** 2).sum(axis=1)
        want = [(d[j], keys[j]) for j in np.lexsort((keys, d))[:k]]
        got = [] if top.keys is None else list(zip(top.dist[top.row == i], top.keys[top.row == i]))
        assert got == want


# --- cells


def test_kmeans_and_cells(data, tmp_path):
    v, base, queries = data
    c = clusters.kmeans(v, 8)
    assert len(c) == 8 and len(clusters.kmeans(np.ones((5, 2)), 3)) == 1
    near = ((v[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert {r.key: r.cell for r in clusters.assign_cells(base, c).collect()} == dict(enumerate(near.tolist()))
    step = {r.cell: (r.n, r.centroid) for r in clusters.lloyd_step(base, clusters.centroid_table(base.sparkSession, c)).collect()}
    for x in step:
        assert step[x][0] == (near == x).sum() and np.allclose(step[x][1], v[near == x].mean(axis=0))
    index = clusters.IvfIndex.build(base, 16, path=str(tmp_path / "cells"))
    assert index.cells.count() == 400
    exact = knn.knn(queries, base, 5)
    assert knn.recall(exact, index.search(queries, 5, nprobe=8)).first().recall >= 90
    assert answers(index.search(queries, 5, nprobe=16)) == answers(exact)
    assert answers(index.search(queries, 5, 16, where=F.col("key") % 2 == 0)) == answers(knn.knn(queries, base, 5, where=F.col("key") % 2 == 0))
    assert clusters.IvfIndex.build(base.limit(0), 4).search(queries, 3).count() == 0


@pytest.mark.parametrize("metric", ["cosine", "inner_product", "euclidean"])
def test_cells_for_other_metrics(data, metric):
    _, base, queries = data
    index = clusters.IvfIndex.build(base, 12, metric)
    assert answers(index.search(queries, 4, nprobe=12)) == answers(knn.knn(queries, base, 4, metric))


# --- compression


def test_product_quantizer(data):
    v, base, queries = data
    pq = compress.ProductQuantizer.train(base, 4, codes=32)
    codes = pq.encode_rows(v)
    got = {r.key: list(r.code) for r in pq.encode(base).collect()}
    assert all(got[i] == codes[i].tolist() for i in got)
    for metric in ("l2_sq", "inner_product", "euclidean"):
        flat = pq.decode_rows(codes)
        want = knn.exact(np.repeat(flat[:3], 400, axis=0), np.tile(flat, (3, 1)), metric).reshape(3, 400)
        assert np.allclose(pq.distances(codes[:3], codes, metric), want)
    assert knn.recall(knn.knn(queries, base, 5), compress.compressed_search(pq, queries, pq.encode(base), 5, widen=20)).first().recall >= 90
    again = compress.ProductQuantizer.from_table(pq.table(base.sparkSession))
    assert np.array_equal(again.codebook, pq.codebook)
    with pytest.raises(InvalidConfig):
        compress.ProductQuantizer.fit(v, 5)
    with pytest.raises(InvalidConfig):
        compress.ProductQuantizer.fit(np.full((4, 4), np.nan), 2)


def test_quantized_cosine_of_zero_vectors():
    pq = compress.ProductQuantizer(np.array([[[0.0], [1.0], [-1.0]]] * 2))
    codes = np.array([[0, 0], [1, 1], [2, 2]], np.uint8)
    assert np.allclose(pq.distances(codes, codes, "cosine"), [[0, 1, 1], [1, 0, 2], [1, 2, 0]])


def test_quantized_distance_expression(spark):
    rng = np.random.default_rng(0)
    pq = compress.ProductQuantizer(rng.normal(size=(3, 4, 2)))
    a, b = rng.integers(0, 4, (20, 3)), rng.integers(0, 4, (20, 3))
    df = spark.createDataFrame([(x.tolist(), y.tolist()) for x, y in zip(a, b)], "a array<int>, b array<int>")
    got = [r[0] for r in df.select(compress.pq_distance("a", "b", pq.codebook)).collect()]
    assert np.allclose(got, np.diag(pq.distances(a.astype(np.uint8), b.astype(np.uint8), "l2_sq")))


def test_truncation(data):
    v, base, queries = data
    t = compress.Truncation(6)
    got = t.search(queries, t.encode(base), 3, "l2_sq")
    assert [[a for a, _ in x] for x in answers(got)] == [[a for a, _ in x] for x in truth(v[:, :6], v[::40, :6], 3, "l2_sq")]


# --- graphs


def slow_prune(ids, v, origin, alpha, most):
    """Take the closest, drop all that it shields, repeat."""
    d = ((v - origin) ** 2).sum(axis=1)
    pool, kept = sorted(range(len(ids)), key=lambda i: (d[i], ids[i])), []
    while pool and len(kept) < most:
        p = pool.pop(0)
        kept.append(p)
        pool = [s for s in pool if d[s] <= alpha * ((v[p] - v[s]) ** 2).sum()]
    return [ids[i] for i in kept]


@pytest.mark.parametrize("alpha", [1.0, 1.1, 1.5])
def test_prune(spark, alpha):
    rng = np.random.default_rng(3)
    for _ in range(40):
        v = rng.integers(-3, 4, (rng.integers(0, 25), 3)).astype(float)
        ids = rng.permutation(len(v)) + 10
        got = graph.robust_prune(ids, v, np.zeros(3), alpha, 5, "l2_sq").tolist()
        assert got == slow_prune(ids.tolist(), v, np.zeros(3), alpha, 5)
    rows = [(float((x**2).sum()), int(i), x.tolist()) for i, x in zip(ids, v)]
    df = spark.createDataFrame([(rows,)], "c array<struct<d:double,id:long,vector:array<double>>>")
    assert [x.id for x in df.select(graph.prune_expr("c", alpha, 5).alias("k")).first().k] == got


def test_graph_search(spark, data):
    v, base, queries = data
    nodes = base.select(F.col("key").alias("id"), "vector")
    every = base.select(F.col("key").alias("qid"), F.col("vector").alias("q"))
    cand = knn.knn(every, base, 20).select(F.col("qid").alias("src"), F.col("key").alias("dst"))
    pruned = graph.prune_edges(cand, nodes, 1.2, 8).collect()
    lists = {}
    for r in sorted(pruned):
        lists.setdefault(r.src, []).append(r.dst)
    by = {}
    for r in cand.where("src != dst").collect():
        by.setdefault(r.src, []).append(r.dst)
    for s in by:
        assert lists[s] == graph.robust_prune(np.array(by[s]), v[by[s]], v[s], 1.2, 8, "l2_sq").tolist()
    edges = kept(graph.link(kept(cand), nodes, 1.2, 16))
    assert tuple(graph.check_graph(edges, nodes, 16).first()) == (0, 0, 0, 0)
    got = graph.beam_search(queries, edges, nodes, 5, width=60)
    rows = answers(got)
    assert all(len(x) <= 5 and [d for _, d in x] == sorted(d for _, d in x) and len({k for k, _ in x}) == len(x) for x in rows)
    assert knn.recall(knn.knn(queries, base, 5), got).first().recall >= 90
    with pytest.raises(EmptyIndex):
        graph.medoid(nodes.limit(0))


def test_layers(spark, data):
    v, base, queries = data
    nodes, edges = graph.build_layers(base.select(F.col("key").alias("id"), "vector"), m=6)
    edges = kept(edges)
    high = nodes.agg(F.max("level")).first()[0]
    assert high >= 1
    for level in range(high + 1):
        ok = graph.check_graph(edges.where(F.col("level") == level), nodes.where(F.col("level") >= level), 12 if level == 0 else 6)
        assert tuple(ok.first()) == (0, 0, 0, 0)
    got = graph.layered_search(queries, edges, nodes, 5, ef=60)
    assert knn.recall(knn.knn(queries, base, 5), got).first().recall >= 90
    first = edges.where("level = 0").orderBy("src", "pos").first()
    assert graph.neighbors(edges, first.src).first().dst == first.dst
    with pytest.raises(EmptyIndex):
        graph.layered_search(queries, edges, nodes.limit(0), 1)


def test_candidates_in_cells(spark, data):
    v, base, _ = data
    nodes = base.select(F.col("key").alias("id"), "vector")
    exact_ones = {tuple(r) for r in graph.candidates(nodes, 8).collect()}
    got = {tuple(r) for r in graph.candidates(nodes, 8, cell_rows=100, spill=3).collect()}
    assert len(got & exact_ones) >= 0.8 * len(exact_ones) and all(a != b for a, b in got)
    same = table(spark, np.ones((300, 2)), "id")
    assert graph.candidates(same, 4, cell_rows=50).groupBy("src").count().count() == 300


def test_compaction_of_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (2, 1), (3, 4), (4, 2), (1, 4)], "src long, dst long")
    nodes = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(1, 5)], "id long, vector array<double>")
    gone = spark.createDataFrame([(2,)], "id long")
    got = {tuple(r) for r in graph.compact_edges(edges, gone, nodes, alpha=1e9).collect()}
    assert got == {(1, 3), (1, 4), (3, 4), (4, 3), (4, 1)}
    bad = spark.createDataFrame([(1, 1), (1, 9), (1, 2), (1, 2)], "src long, dst long")
    assert tuple(graph.check_graph(bad, nodes, 3).first()) == (1, 1, 1, 1)


def test_relink(spark, data):
    v, base, queries = data
    nodes = base.select(F.col("key").alias("id"), "vector")
    edges = kept(graph.link(graph.candidates(nodes, 16), nodes, 1.0, 16))
    changed = spark.createDataFrame([(3,), (200,)], "id long")
    moved = nodes.join(changed, "id", "left_anti").unionByName(spark.createDataFrame([(3, v[50].tolist()), (200, (v[80] + 0.01).tolist())], "id long, vector array<double>"))
    moved = kept(moved)
    got = kept(graph.relink(edges, moved, changed, max_edges=16, width=40))
    assert tuple(graph.check_graph(got, moved, 16).first()) == (0, 0, 0, 0)
    q = moved.where("id in (3, 200)").select(F.col("id").alias("qid"), F.col("vector").alias("q"))
    hits = graph.beam_search(q, got, moved, 2, entry=7, width=40)
    assert {(r.qid, r.key) for r in hits.collect()} == {(3, 3), (3, 50), (200, 200), (200, 80)}


def test_levels(spark):
    u = spark.range(20_000).select(graph.random_level(graph.hashed_uniform(F.col("id")), 16).alias("l")).groupBy("l").count()
    n = {r.l: r["count"] for r in u.collect()}
    assert min(n) == 0 and n[0] > 15 * n[1] * 0.8 and max(n) >= 2


@pytest.mark.parametrize("metric", ["l2_sq", "euclidean", "cosine", "inner_product"])
@pytest.mark.parametrize("shift, scale", [(1e5, 1.0), (1e10, 1.0), (0.0, 1e150), (1e7, 1e-3)])
def test_exact_for_large_norms(spark, metric, shift, scale):
    """Cancellation in large coordinates loses no neighbour; distances beyond what numbers hold come last."""
    rng = np.random.default_rng(5)
    v = shift + scale * rng.standard_normal((300, 6))
    base = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)], "key long, vector array<double>")
    got = knn.knn(base.where("key < 12").selectExpr("key as qid", "vector as q"), base, 7, metric).collect()
    for q in range(12):
        d = knn.exact(np.broadcast_to(v[q], v.shape), v, metric)
        want = [int(x) for x in np.lexsort((np.arange(300), d))[:7]]
        assert [r.key for r in sorted(got, key=lambda r: r.rank) if r.qid == q] == want


def test_all_rows_have_a_place(spark):
    rows = [(1, [0.0, 1.0]), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [1e200, 0.0]), (5, [3.0, 1.0])]
    base = spark.createDataFrame(rows, "key long, vector array<double>")
    q = spark.createDataFrame([(0, [0.0, 0.0])], "qid long, q array<double>")
    assert [r.key for r in knn.knn(q, base, 9, "l2").orderBy("rank").collect()] == [1, 5, 3, 4, 2]
    assert [r.key for r in knn.knn(q, base, 2, "l2").orderBy("rank").collect()] == [1, 5]
    assert sorted(r.key for r in knn.within(q, base, 11.0, "l2").collect()) == [1, 5]


@pytest.mark.parametrize("n", [3000, 12000])
def test_candidates_find_neighbours_at_every_size(spark, n):
    """Recall of the 8 nearest doesn't fall with the number of nodes, and cells stay small."""
    rng = np.random.default_rng(7)
    v = rng.standard_normal((n, 8))
    nodes = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>").repartition(4).cache()
    some = nodes.where("id % 40 = 0")
    truth = knn.knn(some.selectExpr("id as qid", "vector as q"), nodes.selectExpr("id as key", "vector"), 9).where("qid != key")
    found = graph.candidates(nodes, 8, cell_rows=500).where("src % 40 = 0").selectExpr("src as qid", "dst as key")
    assert knn.recall(truth, found).first().recall > 80


def test_candidates_of_equal_vectors(spark):
    nodes = spark.range(3000).selectExpr("id", "array(1.0D, 2.0D) as vector")
    degree = graph.candidates(nodes, 4, cell_rows=200).groupBy("src").count().agg({"count": "min"}).first()[0]
    assert degree >= 4


def test_searches_respect_filters(spark):
    """Only allowed nodes are found, and all of them where there are few."""
    rng = np.random.default_rng(8)
    nodes = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rng.standard_normal((400, 4)))], "id long, vector array<double>").cache()
    edges = graph.link(graph.candidates(nodes, 12), nodes, 1.1, 16).select("src", "dst").cache()
    q = nodes.where("id % 100 = 0").selectExpr("id as qid", "vector as q")
    allowed = nodes.where("id % 2 = 1").select("id")
    truth = knn.knn(q, nodes.selectExpr("id as key", "vector"), 5, where=F.col("key") % 2 == 1)
    got = graph.beam_search(q, edges, nodes, 5, width=64, allowed=allowed)
    assert {r.key % 2 for r in got.collect()} == {1} and knn.recall(truth, got).first().recall > 90
    layers, linked = graph.build_layers(nodes, m=6)
    got = graph.layered_search(q, linked.cache(), layers.cache(), 5, allowed=allowed)
    assert {r.key % 2 for r in got.collect()} == {1} and knn.recall(truth, got).first().recall > 60
    with pytest.raises(SearchUnfinished):
        graph.beam_search(q, edges, nodes, 5, width=64, rounds=2)


def test_few_candidates_all_stay(spark):
    nodes = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [1.1]), (3, [1.2]), (4, [9.0])], "id long, vector array<double>")
    edges = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (4, 1)], "src long, dst long")
    count = {r.src: r["count"] for r in graph.prune_edges(edges, nodes, 1.0, 8).groupBy("src").count().collect()}
    assert count == {0: 1, 4: 1}
    count = {r.src: r["count"] for r in graph.prune_edges(edges, nodes, 1.0, 8, few=4).groupBy("src").count().collect()}
    assert count == {0: 3, 4: 1}


# --- large and cut-off graphs


def test_links_fill_places_and_reach_every_node(spark):
    """Two far groups whose nearest nodes are all of their own: without care one can't be reached from the other."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.standard_normal((60, 16)) * np.r_[1.0, 1.0, rng.uniform(1, 9, 14)], rng.standard_normal((40, 16)) + 500])
    nodes = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>").cache()
    edges = kept(graph.link(graph.candidates(nodes, 8), nodes, 1.1, 8))
    assert tuple(graph.check_graph(edges, nodes, 8).first()) == (0, 0, 0, 0)
    assert edges.groupBy("src").count().where("count >= 8").count() > 90
    start = nodes.where(F.col("id") == graph.medoid(nodes)).select("id")
    assert graph.reached(edges, start, start)[0].count() == 100
    q = nodes.where("id % 10 = 0").selectExpr("id as qid", "vector as q")
    base = nodes.selectExpr("id as key", "vector")
    assert answers(graph.beam_search(q, edges, nodes, 5, width=1000)) == answers(knn.knn(q, base, 5))
    loose = spark.createDataFrame([(0, 0, 1), (1, 0, 0), (2, 0, 3), (3, 0, 2)], "src long, pos long, dst long")
    few = nodes.where("id < 7")  # 4 to 6 have no edges at all
    whole = kept(graph.connected(loose, few, 0, 2))
    assert tuple(graph.check_graph(whole, few, 2).first()) == (0, 0, 0, 0)
    first = few.where("id = 0").select("id")
    assert graph.reached(whole, first, first)[0].count() == 7


def test_wide_search_needs_few_rounds(spark):
    """As wide as the graph: what isn't reached isn't found, and rounds don't grow with the nodes over the beam."""
    nodes = spark.createDataFrame([(k, [float(k)]) for k in range(60)], "id long, vector array<double>").cache()
    edges = spark.createDataFrame([(0, k) for k in range(1, 50)] + [(55, 0)], "src long, dst long")
    q = spark.createDataFrame([(1, [58.0])], "qid long, q array<double>")
    got = graph.beam_search(q, edges, nodes, 2, entry=0, width=60, beam=1, rounds=5)
    assert [r.key for r in got.orderBy("rank").collect()] == [49, 48]
    odd = nodes.where("id % 2 = 0").select("id")
    got = graph.beam_search(q, edges, nodes, 2, entry=0, width=60, beam=1, rounds=5, allowed=odd)
    assert [r.key for r in got.orderBy("rank").collect()] == [48, 46]


def test_searches_enter_groups_of_near_copies(spark):
    """A group that links to itself only is found: by the usual search and by layers."""
    rng = np.random.default_rng(9)
    far = rng.standard_normal((700, 24))
    v = np.concatenate([far / np.linalg.norm(far, axis=1)[:, None] * rng.integers(1, 9, 700)[:, None], 2 * np.eye(24)[3] + 0.01 * rng.standard_normal((100, 24))])
    nodes = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>").cache()
    q = nodes.where("id >= 700 and id % 10 = 0").selectExpr("id as qid", "vector as q")
    truth = knn.knn(q, nodes.selectExpr("id as key", "vector"), 5).cache()
    edges = kept(graph.link(graph.candidates(nodes, 16), nodes, 1.1, 24))
    assert tuple(graph.check_graph(edges, nodes, 24).first()) == (0, 0, 0, 0)
    assert knn.recall(truth, graph.beam_search(q, edges, nodes, 5, width=64)).first().recall > 90
    layers, linked = graph.build_layers(nodes)
    assert knn.recall(truth, graph.layered_search(q, kept(linked), kept(layers), 5, ef=60)).first().recall > 90


@pytest.mark.parametrize("metric", ["cosine"])
def test_small_graphs_are_searched_and_pruned_in_memory(spark, monkeypatch, metric):
    """What is done in memory equals what joins do, and a search writes one table, however many rounds it takes."""
    rng = np.random.default_rng(10)
    v = rng.standard_normal((200, 6))
    v[50:70], v[90] = v[3], 0
    nodes = spark.createDataFrame([(3 * k - 50, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>").cache()
    some = graph.candidates(nodes, 16, metric).union(spark.createDataFrame([(1, 9999), (1, 1), (9999, 1)], "src long, dst long")).cache()
    every = graph._whole(nodes, metric)
    for few, fill in ((0, True), (30, False)):
        rows = [sorted(tuple(r) for r in graph.prune_edges(some, nodes, 1.1, 8, metric, few, fill, x).collect()) for x in (None, every)]
        assert rows[0] == rows[1]
    edges = graph.prune_edges(some, nodes, 1.1, 8, metric, 0, True, every).cache()
    q = nodes.where("id % 25 = 0").selectExpr("id as qid", "vector as q").cache()
    allowed = nodes.where("id % 2 = 0").select("id")
    entries = q.selectExpr("qid", "1L as id").union(q.selectExpr("qid", "4L as id"))
    written = []
    monkeypatch.setattr(graph, "kept", lambda d: written.append(1) or kept(d))

    def found():
        return [answers(graph.beam_search(q, edges, nodes, 5, entry, width=20, metric=metric, allowed=a)) for entry, a in ((1, allowed), (entries, None))]

    whole = found()
    assert len(written) == 2
    monkeypatch.setattr(graph, "WHOLE_ROWS", 0)
    joined = found()
    assert [[[k for k, _ in x] for x in part] for part in whole] == [[[k for k, _ in x] for x in part] for part in joined]


def test_small_graphs_are_linked_and_followed_on_the_driver(spark, monkeypatch):
    """No table is written to link a small graph, to reach all its nodes, or to search it as widely as it is."""
    written = []
    monkeypatch.setattr(graph, "kept", lambda d: written.append(d) or kept(d))
    rng = np.random.default_rng(12)
    v = rng.standard_normal((300, 8))
    v[100:160], v[200:230] = v[0] + 20, v[1] - 20 + 1e-3 * rng.standard_normal((30, 8))
    nodes = spark.createDataFrame([(3 * k - 50, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>").cache()
    near = graph.candidates(nodes, 12).cache()
    q = nodes.where("id % 20 = 1").selectExpr("id as qid", "vector as q").cache()
    truth = answers(knn.knn(q, nodes.selectExpr("id as key", "vector"), 5))
    for metric in ("l2_sq", "euclidean"):
        edges = graph.link(near, nodes, 1.1, 8, metric).cache()
        assert tuple(graph.check_graph(edges, nodes, 8).first()) == (0, 0, 0, 0)
        assert answers(graph.beam_search(q, edges, nodes, 5, width=1000)) == truth
    assert not written
    # parts without edges between them, one of them without any, from an entry in the middle
    loose = edges.where("src >= 0 and src < 300 and dst >= 0 and dst < 300 and src div 100 = dst div 100").cache()
    few = nodes.where("id >= 0 and id < 310")
    whole = graph.connected(loose, few, 151, 8).cache()
    assert tuple(graph.check_graph(whole, few, 8).first()) == (0, 0, 0, 0)
    first = few.where("id = 151").select("id")
    assert len(written) == 1 and graph.reached(whole, first, first)[0].count() == few.count()


@pytest.mark.parametrize("metric", ["l2_sq", "cosine", "inner_product", "euclidean"])
def test_pruning_by_all_pairs_equals_the_rule(metric):
    """Copies and near copies, whose distances rounding leaves open, included."""
    rng = np.random.default_rng(13)
    v = rng.standard_normal((400, 16)) * rng.integers(1, 9, 400)[:, None]
    v[50:80], v[100:130], v[150] = v[50], v[100] + 1e-9 * rng.standard_normal((30, 16)), 0
    for k in range(40):
        c = np.unique(np.concatenate((rng.integers(0, 400, 40), rng.integers(50, 151, 40))))
        c = c[c != 10 * k]
        for alpha in (1.0, 1.1):
            assert graph._chosen(v, 10 * k, c, alpha, 12, metric, 0, False).tolist() == graph.robust_prune(c, v[c], v[10 * k], alpha, 12, metric).tolist()


def test_compressed_search_keeps_what_codes_leave_open(spark):
    """Codes so coarse that the nearest by code are not the nearest: none is lost, also among zeros and equal vectors."""
    rng = np.random.default_rng(6)
    v = rng.standard_normal((900, 8)) * rng.integers(0, 9, 900)[:, None]
    v[100:110] = v[7]
    base = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "key long, vector array<double>").cache()
    q = base.where("key % 90 = 7").selectExpr("key as qid", "vector as q")
    pq = compress.ProductQuantizer.fit(v, 4, 3)
    for metric in ("l2_sq", "cosine", "inner_product"):
        assert answers(compress.compressed_search(pq, q, pq.encode(base), 5, metric)) == answers(knn.knn(q, base, 5, metric))
