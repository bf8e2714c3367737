"""Registered queries of the vector engine, each with DuckDB SQL for the same rows where SQL can express it.

Vectors are the embeddings scaled by 1 + label, so that metrics rank differently. Search queries are all rows whose id is
divisible by 100; distances are rounded to 6 digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors as V
from .operators import graph, mutate
from .operators.clusters import IvfIndex, assign_cells, cell_members, centroid_table, kmeans_all, lloyd_step
from .operators.compress import ProductQuantizer, Truncation, compressed_search
from .operators.knn import best, ground_truth, knn, recall, sample, within
from .plans.table import VectorTable
from .sources import files
from .sources.scratch import kept, scratch
from .streaming.mutations import follow

K = 10


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("label")))
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), "label", v.alias("vector"))


def _queries(base: DataFrame) -> DataFrame:
    return base.where("key % 100 = 0").select(F.col("key").alias("qid"), F.col("vector").alias("q"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", F.round("distance", 6))


def _knn(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = _base(spark, sf_dir)
        return _rounded(knn(_queries(b), b, K, metric))

    return run


def knn_filtered(spark, sf_dir):
    b = _base(spark, sf_dir)
    return _rounded(knn(_queries(b), b, K, "l2", where=F.col("label") % 2 == 0))


def knn_tombstoned(spark, sf_dir):
    b = _base(spark, sf_dir)
    return _rounded(knn(_queries(b), b, K, "l2", tombstones=b.where("key % 7 = 0").select("key")))


def radius_search(spark, sf_dir):
    b = _base(spark, sf_dir)
    return _rounded(within(_queries(b), b, 9.0, "l2"))


def nan_to_num(spark, sf_dir):
    odd = F.transform("embedding", lambda x: F.when(x > 0.2, F.lit(float("inf"))).when(x < -0.2, F.lit(float("-inf"))).when((x > 0.1) & (x < 0.15), F.lit(float("nan"))).otherwise(x.cast("double")))
    d = _read(spark, sf_dir, "embeddings").select("vec_id", V.nan_to_num(odd).alias("v"))
    most = F.lit(V.MAX_FINITE["f32"])

    def count(test):
        return F.size(F.filter("v", test)).cast("long")

    return d.select("vec_id", count(lambda x: x == most).alias("n_most"), count(lambda x: x == -most).alias("n_least"), count(lambda x: x == 0).alias("n_zero"))


def normalize(spark, sf_dir):
    d = _base(spark, sf_dir).select("key", V.normalize("vector").alias("v"))
    return d.select("key", F.round(V.norm_sq("v"), 6).alias("norm_sq"), F.round(F.element_at("v", 1), 6).alias("first"))


def norms(spark, sf_dir):
    d = _read(spark, sf_dir, "embeddings").join(_base(spark, sf_dir).select(F.col("key").alias("vec_id"), "vector"), "vec_id")
    s = V.dot_and_norms("embedding", "vector")
    return d.select("vec_id", *(F.round(s[c], 6).alias(c) for c in ("dot", "norm_a", "norm_b")))


def pairwise_dist(spark, sf_dir):
    b = _base(spark, sf_dir)
    return _rounded(within(_queries(b), b, float("inf"), "euclidean"))


def centroid_dist(spark, sf_dir):
    b = _base(spark, sf_dir)
    means = b.select("label", F.posexplode("vector").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m"))
    c = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda r: r["m"]).alias("c"))
    return b.join(c, "label").select("key", F.round(V.euclidean("vector", "c"), 6).alias("distance"))


def _start(b: DataFrame) -> DataFrame:
    return b.where("key < 8").select(F.col("key").cast("int").alias("cell"), F.col("vector").alias("centroid"))


def kmeans_one_lloyd_step(spark, sf_dir):
    b = _base(spark, sf_dir)
    d = lloyd_step(b, _start(b))
    return d.select("cell", "n", F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def cluster_members(spark, sf_dir):
    import numpy as np

    b = _base(spark, sf_dir)
    c = np.array([r.centroid for r in _start(b).orderBy("cell").collect()])  # eight rows
    return cell_members(assign_cells(b, c))


def _quantized(spark, sf_dir):
    return _base(spark, sf_dir).select("key", V.qi8_quantize("vector").alias("vector"))


def qi8_quantize(spark, sf_dir):
    d = _quantized(spark, sf_dir)
    total = F.aggregate("vector.data", F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select("key", F.round(F.col("vector.scale").cast("double"), 6).alias("scale"), F.col("vector.zero_point").cast("long").alias("zero_point"), total.alias("total"))


def _qi8(metric: str):
    def run(spark, sf_dir):
        d = _quantized(spark, sf_dir)
        wide = d.select("key", V.qi8_dequantize("vector").alias("vector"))
        near = knn(_queries(wide), wide, K, metric).select("qid", "key")
        # distances from the integer sums
        pairs = near.join(d, "key").join(d.select(F.col("key").alias("qid"), F.col("vector").alias("q")), "qid")
        return _rounded(best(pairs.select("qid", "key", V.QI8_METRICS[metric](F.col("q"), F.col("vector")).alias("distance")), K))

    return run


def trunc_knn(spark, sf_dir):
    b = _base(spark, sf_dir)
    t = Truncation(16)
    return _rounded(t.search(_queries(b), t.encode(b), K, "l2"))


def trunc_rerank(spark, sf_dir):
    b = _base(spark, sf_dir)
    t = Truncation(16)
    return _rounded(compressed_search(t, _queries(b), t.encode(b), K, "l2"))


def _codebook(b: DataFrame) -> ProductQuantizer:
    import numpy as np

    rows = np.array([r.vector for r in b.where("key < 16").orderBy("key").collect()])  # sixteen rows
    return ProductQuantizer(rows.reshape(16, 8, -1).transpose(1, 0, 2))


def pq_encode_fixed_codebook(spark, sf_dir):
    b = _base(spark, sf_dir)
    d = _codebook(b).encode(b)
    return d.select("key", F.lower(F.hex("code")).alias("code"))


def pq_sdc_l2(spark, sf_dir):
    b = _base(spark, sf_dir)
    pq = _codebook(b)
    return _rounded(pq.search(_queries(b), pq.encode(b), K, "l2"))


def recall_at_k(spark, sf_dir):
    b = _base(spark, sf_dir)
    r = recall(knn(_queries(b), b, K, "l2"), trunc_knn(spark, sf_dir))
    return r.withColumn("recall", F.round("recall", 6))


def _log(spark, sf_dir):
    op = F.when(F.col("event_id") % 5 == 0, "delete").otherwise("insert")
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("key"), F.array(F.col("value")).alias("vector"))


def upsert_latest(spark, sf_dir):
    b = _base(spark, sf_dir).select("key", F.slice("vector", 1, 1).alias("vector"))
    return mutate.upsert(b, _log(spark, sf_dir)).select("key", F.round(F.element_at("vector", 1), 6).alias("first"))


def _dead(b):
    return b.where("key % 7 = 0").select("key")


def set_outcome(spark, sf_dir):
    b = _base(spark, sf_dir)
    return mutate.set_outcomes(b, _dead(b), _log(spark, sf_dir))


def delete_apply(spark, sf_dir):
    b = _base(spark, sf_dir)
    return mutate.delete_outcomes(b, _dead(b), _log(spark, sf_dir))


def live_counts(spark, sf_dir):
    b = _base(spark, sf_dir).withColumn("id", F.col("key"))
    return mutate.counts(b, _dead(b))


def _edges(spark, sf_dir):
    """A made graph: each node points to four others, on two levels."""
    n = _base(spark, sf_dir).select("key")
    total = n.agg(F.count(F.lit(1))).scalar()
    j = F.explode(F.sequence(F.lit(1), F.lit(4))).alias("j")
    d = n.select("key", j, total.alias("n"))
    return d.select((F.col("j") % 2).alias("level"), F.col("key").alias("src"), ((F.col("key") * 7 + F.col("j") * 13) % F.col("n")).alias("dst")).where("src != dst")


def merged_neighbors(spark, sf_dir):
    d = graph.merged_neighbors(_edges(spark, sf_dir))
    return d.select("src", F.array_join("neighbors", ",").alias("neighbors"))


def reverse_edges(spark, sf_dir):
    return graph.reverse_edges(_edges(spark, sf_dir)).distinct()


def two_hop(spark, sf_dir):
    return graph.two_hop(_edges(spark, sf_dir))


def compaction_candidates(spark, sf_dir):
    e = _edges(spark, sf_dir).select("src", "dst").distinct()
    gone = _dead(_base(spark, sf_dir)).withColumnRenamed("key", "id")
    nodes = _base(spark, sf_dir).select(F.col("key").alias("id"), "vector")
    # a bound that prunes nothing, so that candidates can be compared
    return graph.compact_edges(e, gone, nodes, alpha=1e18, max_edges=1 << 20).distinct()


def hnsw_level(spark, sf_dir):
    u = (F.pmod(F.col("key") * 7919, F.lit(10007)) + 1) / F.lit(10007.0)
    return _base(spark, sf_dir).select("key", graph.random_level(u, 16).alias("level"))


#: Wide enough for a search to reach every node that it can: then it has to equal the exact one.
WIDE = 1 << 20


def ivf_knn(spark, sf_dir):
    """All cells probed: the same as a scan, by way of a stored index."""
    b = _base(spark, sf_dir)
    return _rounded(IvfIndex.build(b, 32, path=scratch(spark)).search(_queries(b), K, nprobe=32))


def ivf_recall(spark, sf_dir):
    """A quarter of the cells probed: how many of the true neighbours are found, and whether that is enough."""
    b = _base(spark, sf_dir)
    return _enough(b, IvfIndex.build(b, 32, path=scratch(spark)).search(_queries(b), K, nprobe=8))


def _enough(b, got, least: float = 90.0):
    return recall(knn(_queries(b), b, K, "l2"), got).select("total", (F.col("recall") >= least).alias("enough"))


def pq_train_search(spark, sf_dir):
    b = _base(spark, sf_dir)
    pq = ProductQuantizer.train(b, 16, codes=64, rounds=10)
    return _enough(b, compressed_search(pq, _queries(b), pq.encode(b), K, "l2"), 75.0)


def _linked(b):
    nodes = b.select(F.col("key").alias("id"), "vector")
    return graph.link(graph.candidates(nodes, 16), nodes, 1.1, 24), nodes


def prune_graph(spark, sf_dir):
    """The pruning rule over each search query's 16 nearest."""
    b = _base(spark, sf_dir)
    near = knn(_queries(b), b, 17, "l2").select(F.col("qid").alias("src"), F.col("key").alias("dst"))
    return graph.prune_edges(near, b.select(F.col("key").alias("id"), "vector"), 2.0, 6)


def graph_integrity(spark, sf_dir):
    edges, nodes = _linked(_base(spark, sf_dir))
    return graph.check_graph(edges, nodes, 24)


def beam_search(spark, sf_dir):
    b = _base(spark, sf_dir)
    edges, nodes = _linked(b)
    return _rounded(graph.beam_search(kept(_queries(b)), kept(edges.select("src", "dst")), nodes, K, width=WIDE, beam=64))


def beam_recall(spark, sf_dir):
    """The same graph searched by usual settings."""
    b = _base(spark, sf_dir)
    edges, nodes = _linked(b)
    return _enough(b, graph.beam_search(kept(_queries(b)), kept(edges.select("src", "dst")), nodes, K, width=64, beam=4))


def layered_search(spark, sf_dir):
    b = _base(spark, sf_dir)
    nodes, edges = graph.build_layers(b.select(F.col("key").alias("id"), "vector"))
    return _enough(b, graph.layered_search(kept(_queries(b)), kept(edges), kept(nodes), K, ef=100))


def beam_filtered(spark, sf_dir):
    """Results of even labels only, reached through all nodes."""
    b = _base(spark, sf_dir)
    edges, nodes = _linked(b)
    return _rounded(graph.beam_search(kept(_queries(b)), kept(edges.select("src", "dst")), nodes, K, width=WIDE, beam=64, allowed=b.where("label % 2 = 0").select(F.col("key").alias("id"))))


def half_rounding(spark, sf_dir):
    d = _read(spark, sf_dir, "embeddings")
    return d.select("vec_id", F.round(V.norm_sq(V.to_f16("embedding")), 9).alias("f16"), F.round(V.norm_sq(V.to_bf16("embedding")), 9).alias("bf16"))


def truth_arrays(spark, sf_dir):
    b = _base(spark, sf_dir)
    d = ground_truth(_queries(b), b, K, "euclidean", skip_self=True)
    return d.select("qid", F.array_join(F.transform("keys", lambda x: x.cast("string")), ",").alias("keys"))


def random_sample(spark, sf_dir):
    """Whether a sample has the rows asked for, all different and of the table, and is the same when drawn again."""
    d = _read(spark, sf_dir, "embeddings").select("vec_id")
    got, again = sample(d, 50, 3), sample(d.repartition(7), 50, 3)
    one = got.join(d, "vec_id", "left_semi").join(again, "vec_id", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("different"))
    return one


def table_query(spark, sf_dir):
    """A table in memory: half of the rows inserted, some deleted, then searched."""
    b = _base(spark, sf_dir)
    t = VectorTable.from_df(b.where("key % 2 = 0"), {"dim": 64, "metric": "cosine"})
    t.insert(b.where("key % 2 = 1"))
    t.delete(b.where("key % 7 = 0").select("key"))
    d = t.query(_queries(b), K)
    return d.select("qid", "rank", F.col("key").cast("long").alias("key"), F.round("distance", 4).alias("distance"))


def _changed(spark, sf_dir, config=None, named=lambda d: d):
    """A table on disk after inserts, an update, deletes, compactions and changes since. named: gives rows the table's keys."""
    b = _base(spark, sf_dir)
    t = VectorTable.create(spark, scratch(spark), {"dim": 64, "metric": "cosine"} | (config or {}))
    t.insert(named(b.where("key % 2 = 0")))
    t.insert(named(b.where("key % 5 = 0").withColumn("vector", F.transform("vector", lambda x: -x))))
    return b, t


def table_on_disk(spark, sf_dir):
    b, t = _changed(spark, sf_dir)
    t.compact()
    t.insert(b.where("key % 2 = 1 or key % 5 = 0"))
    t.delete(b.where("key % 7 = 0").select("key"))
    d = VectorTable.open(spark, t.path).query(_queries(b), K)
    return d.select("qid", "rank", F.col("key").cast("long").alias("key"), F.round("distance", 4).alias("distance"))


def table_by_graph(spark, sf_dir):
    """The same by the table's graph, mended by a compaction, with a search wide enough to be exact. Keys are padded, so that
    the table, whose keys are strings, breaks ties as numbers do."""

    def named(d):
        return d.withColumn("key", F.format_string("%019d", "key"))

    b, t = _changed(spark, sf_dir, {"query_search_list_cap": WIDE, "beam_width": 64, "max_edges": 24}, named)
    t.build_index("graph")
    t.insert(named(b.where("key % 2 = 1 and key % 3 = 0 or key % 5 = 0")))
    t.delete(named(b.where("key % 7 = 0").select("key")))
    t.compact()
    t.insert(named(b.where("key % 2 = 1 and key % 7 <> 0")))
    d = VectorTable.open(spark, t.path).query(_queries(b), K)
    return d.select("qid", "rank", F.col("key").cast("long").alias("key"), F.round("distance", 4).alias("distance"))


def table_compacted(spark, sf_dir):
    """Rows of a table after a compaction, and what the compaction counted."""
    b, t = _changed(spark, sf_dir)
    t.delete(b.where("key % 7 = 0").select("key"))
    done = t.compact()
    counts = [F.lit(done[n]).cast("long").alias(n) for n in ("rows", "deleted", "changed")]
    return t.rows().select(F.col("key").cast("long").alias("key"), F.round(F.element_at("vector", 1).cast("double"), 4).alias("first"), *counts)


def table_codes(spark, sf_dir):
    """A table that its size has compressed: recall by stored codes."""
    b = _base(spark, sf_dir)
    t = VectorTable.create(spark, scratch(spark), {"dim": 64, "compression_threshold": 100, "pq_subspaces": 16})
    t.insert(b)
    t.compact()
    return _enough(b, t.search(_queries(b), K).withColumn("key", F.col("key").cast("long"))).withColumn("compressed", F.lit(t.compressed()))


def table_qi8(spark, sf_dir):
    b = _base(spark, sf_dir)
    t = VectorTable.from_df(b.limit(0), {"dim": 64})
    t.insert_qi8(b.withColumn("vector", V.qi8_quantize("vector")))
    d = t.query_qi8(_queries(b).withColumn("q", V.qi8_quantize("q")), K)
    return d.select("qid", "rank", F.col("key").cast("long").alias("key"), F.round("distance", 3).alias("distance"))


def table_stream(spark, sf_dir):
    """A stream of changes followed into a table on disk."""
    t = VectorTable.create(spark, scratch(spark), {"dim": 1})
    t.insert(_base(spark, sf_dir).select("key", F.slice("vector", 1, 1).alias("vector")))
    events = _read(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 5 == 0, "delete").otherwise("insert")
    changes = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("key"), F.array(F.col("value").cast("float")).alias("vector"))
    follow(t, changes, scratch(spark)).awaitTermination()
    return t.rows().select(F.col("key").cast("long").alias("key"), F.round(F.element_at("vector", 1).cast("double"), 3).alias("first"))


def stored_vectors(spark, sf_dir):
    """Vectors written as 8-bit structs with what they are, and read back."""
    path = scratch(spark)
    files.save_vectors(_base(spark, sf_dir).select("key", "vector"), path, "qi8")
    d = files.load_vectors(spark, path, "qi8", 64)
    return d.select("key", F.round(F.col("vector.scale").cast("double"), 6).alias("scale"), F.col("vector.zero_point").cast("long").alias("zero_point"), F.aggregate("vector.data", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def kmeans_converged(spark, sf_dir):
    """Lloyd's to its end: whether every row is in the cell of its nearest centroid, and centroids are their members' means."""
    import numpy as np

    b = _base(spark, sf_dir)
    start = np.array([r.vector for r in b.where("key < 8").orderBy("key").collect()])
    cells, c, _ = kmeans_all(b.select("key", "vector"), start, None)
    again = {r.cell: r.centroid for r in lloyd_step(b, centroid_table(spark, c)).collect()}
    still = all(np.array_equal(c[k], v) for k, v in again.items())
    return cells.agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(bool(still)).alias("settled"))


def pq_sdc(metric: str):
    def run(spark, sf_dir):
        b = _base(spark, sf_dir)
        pq = _codebook(b)
        return _rounded(pq.search(_queries(b), pq.encode(b), K, metric))

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {"knn_l2": _knn("l2"), "knn_cosine": _knn("cosine"), "knn_ip": _knn("ip"), "knn_euclid": _knn("euclidean"), "qi8_l2": _qi8("l2_sq"), "qi8_cosine": _qi8("cosine"), "qi8_ip": _qi8("inner_product")}
    found |= {"pq_sdc_ip": pq_sdc("ip"), "pq_sdc_cosine": pq_sdc("cosine")}
    more = [knn_filtered, knn_tombstoned, radius_search, nan_to_num, normalize, norms, pairwise_dist, centroid_dist, kmeans_one_lloyd_step, cluster_members, qi8_quantize, trunc_knn, trunc_rerank]
    more += [pq_encode_fixed_codebook, pq_sdc_l2, recall_at_k, upsert_latest, set_outcome, delete_apply, live_counts, merged_neighbors, reverse_edges, two_hop, compaction_candidates, hnsw_level]
    more += [ivf_knn, ivf_recall, pq_train_search, prune_graph, graph_integrity, beam_search, beam_recall, beam_filtered, layered_search, half_rounding, truth_arrays, random_sample, table_query]
    more += [table_on_disk, table_by_graph, table_compacted, table_codes, table_qi8, table_stream, stored_vectors, kmeans_converged]
    return found | {f.__name__: f for f in more}


# --- SQL


_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + label))"
_E = f"e AS (SELECT vec_id AS key, label, {_V} AS v FROM embeddings)"


def _sum(zipped: str, term: str) -> str:
    return f"list_sum(list_transform({zipped}, lambda p: {term}))"


def _l2(a: str, b: str) -> str:
    return _sum(f"list_zip({a}, {b})", "(p[1] - p[2]) * (p[1] - p[2])")


def _dot(a: str, b: str) -> str:
    return _sum(f"list_zip({a}, {b})", "p[1] * p[2]")


def _metric(name: str, a: str, b: str) -> str:
    if name == "cosine":
        return f"CASE WHEN {_dot(a, a)} = 0 OR {_dot(b, b)} = 0 THEN 1.0 ELSE 1 - {_dot(a, b)} / sqrt({_dot(a, a)} * {_dot(b, b)}) END"
    return {"l2": _l2(a, b), "euclidean": f"sqrt({_l2(a, b)})", "ip": f"1 - {_dot(a, b)}"}[name]


def _top(distance: str, source: str = "e", where: str = "TRUE", ctes: str = _E, k: int = K) -> str:
    return (
        f"WITH {ctes}, d AS (SELECT q.key AS qid, b.key AS key, {distance} AS distance FROM {source} q, {source} b WHERE q.key % 100 = 0 AND {where}), "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, key) AS rank FROM d) SELECT qid, rank, key, round(distance, 6) AS distance FROM r WHERE rank <= {k}"
    )


_QI8 = (
    _E + ", q0 AS (SELECT key, v, least(0.0, list_min(v)) AS low, greatest(0.0, list_max(v)) AS high FROM e), "
    "q1 AS (SELECT key, v, low, CASE WHEN high > low THEN (high - low) / 255.0 ELSE CAST(1 AS DOUBLE) END AS s FROM q0), "
    "q2 AS (SELECT key, v, s, greatest(-128.0, least(127.0, floor(-128.0 - low / s + 0.5))) AS z FROM q1), "
    "t AS (SELECT key, list_transform(v, lambda x: greatest(-128.0, least(127.0, floor(x / s + z + 0.5)))) AS data, CAST(CAST(s AS FLOAT) AS DOUBLE) AS s, z FROM q2), "
    "u AS (SELECT key, list_transform(data, lambda x: (x - z) * s) AS v FROM t)"
)
_EDGES = _E + ", edges AS (SELECT j % 2 AS level, key AS src, (key * 7 + j * 13) % (SELECT count(*) FROM e) AS dst FROM e, range(1, 5) AS r(j) WHERE key <> (key * 7 + j * 13) % (SELECT count(*) FROM e))"
_CODES = (
    _E + ", book AS (SELECT key AS code, s, v[s * 8 + 1 : s * 8 + 8] AS c FROM e, range(0, 8) AS r(s) WHERE key < 16), "
    f"near AS (SELECT e.key, book.s, book.code, book.c, row_number() OVER (PARTITION BY e.key, book.s ORDER BY {_l2('e.v[book.s * 8 + 1 : book.s * 8 + 8]', 'book.c')}, book.code) AS r FROM e, book)"
)
_DEAD = "SELECT vec_id AS key FROM embeddings WHERE vec_id % 7 = 0"
_LOG = "SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'delete' ELSE 'insert' END AS op, user_id AS key, value FROM events"
_EXACT = _top(_metric("l2", "q.v", "b.v"))
_TRUNC = _top(_metric("l2", "q.v[1:16]", "b.v[1:16]"))
_MOST = "CAST(3.4028234663852886e38 AS DOUBLE)"


def oracle_sql() -> dict[str, str]:
    near = f"SELECT b.key, c.key AS cell, b.v, row_number() OVER (PARTITION BY b.key ORDER BY {_l2('b.v', 'c.v')}, c.key) AS r FROM e b, e c WHERE c.key < 8"
    straight = "SELECT src, dst FROM edges WHERE src NOT IN (SELECT key FROM dead) AND dst NOT IN (SELECT key FROM dead)"
    through = "SELECT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src NOT IN (SELECT key FROM dead) AND a.dst IN (SELECT key FROM dead) AND b.dst NOT IN (SELECT key FROM dead) AND a.src <> b.dst"
    enough = "SELECT {} * count(*) AS total, true AS enough FROM embeddings WHERE vec_id % 100 = 0".format(K)
    on_disk = _top(_metric("cosine", "q.v", "b.v"), where="b.key % 7 <> 0").replace("round(distance, 6)", "round(distance, 4)")
    pairs = f"SELECT a.src, a.pos AS i, b.pos AS j, {_l2('a.v', 'b.v')} AS d FROM c a JOIN c b ON a.src = b.src"

    def half(bits: int, least: int) -> str:
        step = f"pow(2.0, greatest(floor(log2(abs(x))), {least}) - {bits})"
        return f"list_transform(v, lambda x: CASE WHEN x = 0 THEN 0.0 ELSE round_even(x / {step}, 0) * {step} END)"

    return {
        "ivf_knn": _EXACT,
        "beam_search": _EXACT,
        "beam_filtered": _top(_metric("l2", "q.v", "b.v"), where="b.label % 2 = 0"),
        "ivf_recall": enough,
        "beam_recall": enough,
        "layered_search": enough,
        "pq_train_search": enough,
        "table_codes": enough.replace("true AS enough", "true AS enough, true AS compressed"),
        "graph_integrity": "SELECT CAST(0 AS BIGINT) AS self_edges, CAST(0 AS BIGINT) AS missing_ends, CAST(0 AS BIGINT) AS repeats, CAST(0 AS BIGINT) AS over_degree",
        "random_sample": "SELECT least(50, count(*)) AS n, least(50, count(*)) AS different FROM embeddings",
        "prune_graph": f"WITH RECURSIVE {_E}, n AS (SELECT q.key AS src, b.key AS dst, b.v, {_l2('q.v', 'b.v')} AS d FROM e q, e b WHERE q.key % 100 = 0), "
        f"r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS place FROM n), c AS (SELECT src, dst, v, d, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS pos FROM r WHERE place <= 17 AND src <> dst), "
        f"p AS ({pairs}), m AS (SELECT src, i, list(d ORDER BY j) AS row FROM p GROUP BY src, i), x AS (SELECT c.src, c.pos, c.d, m.row FROM c JOIN m ON c.src = m.src AND c.pos = m.i), "
        "w AS (SELECT src, CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT src FROM c) UNION ALL "
        "SELECT w.src, x.pos, CASE WHEN len(w.kept) < 6 AND len(list_filter(w.kept, lambda k: x.d > 2.0 * x.row[k])) = 0 THEN list_append(w.kept, x.pos) ELSE w.kept END FROM w JOIN x ON x.src = w.src AND x.pos = w.pos + 1), "
        "z AS (SELECT src, kept FROM w QUALIFY row_number() OVER (PARTITION BY src ORDER BY pos DESC) = 1), y AS (SELECT src, unnest(kept) AS place, unnest(range(0, len(kept))) AS pos FROM z) "
        "SELECT y.src, y.pos, c.dst FROM y JOIN c ON c.src = y.src AND c.pos = y.place",
        "half_rounding": f"WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), h AS (SELECT vec_id, {half(10, -14)} AS a, {half(7, -126)} AS b FROM d) SELECT vec_id, round({_dot('a', 'a')}, 9) AS f16, round({_dot('b', 'b')}, 9) AS bf16 FROM h",
        "table_on_disk": on_disk,
        "table_by_graph": on_disk,
        "table_compacted": f"WITH {_E}, r AS (SELECT key, CASE WHEN key % 5 = 0 THEN -v[1] ELSE v[1] END AS x FROM e WHERE (key % 2 = 0 OR key % 5 = 0) AND key % 7 <> 0) "
        "SELECT key, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 4) AS first, (SELECT count(*) FROM r) AS rows, (SELECT count(*) FROM e WHERE key % 7 = 0) AS deleted, (SELECT count(*) FROM r) AS changed FROM r",
        "table_qi8": _top(_metric("l2", "q.v", "b.v"), "u", ctes=_QI8).replace("round(distance, 6)", "round(distance, 3)"),
        "table_stream": f"WITH {_E}, log AS ({_LOG}), last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1), a AS (SELECT key, v[1] AS x FROM e WHERE key NOT IN (SELECT key FROM last) UNION ALL SELECT key, value AS x FROM last WHERE op <> 'delete') SELECT key, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 3) AS first FROM a",
        "stored_vectors": f"WITH {_QI8} SELECT key, round(s, 6) AS scale, CAST(z AS BIGINT) AS zero_point, CAST(list_sum(data) AS BIGINT) AS total FROM t",
        "kmeans_converged": "SELECT count(*) AS n, true AS settled FROM embeddings",
        "pq_sdc_ip": _top(_metric("ip", "q.v", "b.v"), "p", ctes=_CODES + ", p AS (SELECT key, flatten(list(c ORDER BY s)) AS v FROM near WHERE r = 1 GROUP BY key)"),
        "pq_sdc_cosine": _top(_metric("cosine", "q.v", "b.v"), "p", ctes=_CODES + ", p AS (SELECT key, flatten(list(c ORDER BY s)) AS v FROM near WHERE r = 1 GROUP BY key)"),
        "knn_l2": _EXACT,
        "knn_cosine": _top(_metric("cosine", "q.v", "b.v")),
        "knn_ip": _top(_metric("ip", "q.v", "b.v")),
        "knn_euclid": _top(_metric("euclidean", "q.v", "b.v")),
        "knn_filtered": _top(_metric("l2", "q.v", "b.v"), where="b.label % 2 = 0"),
        "knn_tombstoned": _top(_metric("l2", "q.v", "b.v"), where="b.key % 7 <> 0"),
        "radius_search": f"WITH {_E}, d AS (SELECT q.key AS qid, b.key AS key, {_l2('q.v', 'b.v')} AS distance FROM e q, e b WHERE q.key % 100 = 0) SELECT qid, key, round(distance, 6) AS distance FROM d WHERE distance <= 9.0",
        "pairwise_dist": f"WITH {_E} SELECT q.key AS qid, b.key AS key, round(sqrt({_l2('q.v', 'b.v')}), 6) AS distance FROM e q, e b WHERE q.key % 100 = 0",
        "nan_to_num": "WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0.2 THEN 1 WHEN x < -0.2 THEN 2 WHEN (x > 0.1 AND x < 0.15) OR x = 0 THEN 3 ELSE 0 END) AS v FROM embeddings) "
        "SELECT vec_id, len(list_filter(v, lambda x: x = 1)) AS n_most, len(list_filter(v, lambda x: x = 2)) AS n_least, len(list_filter(v, lambda x: x = 3)) AS n_zero FROM d",
        "normalize": f"WITH {_E}, n AS (SELECT key, v, sqrt({_dot('v', 'v')}) AS l FROM e), w AS (SELECT key, list_transform(v, lambda x: CASE WHEN l = 0 THEN x ELSE x / l END) AS v FROM n) SELECT key, round({_dot('v', 'v')}, 6) AS norm_sq, round(v[1], 6) AS first FROM w",
        "norms": f"WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a, {_V} AS b FROM embeddings) SELECT vec_id, round({_dot('a', 'b')}, 6) AS dot, round({_dot('a', 'a')}, 6) AS norm_a, round({_dot('b', 'b')}, 6) AS norm_b FROM d",
        "centroid_dist": f"WITH {_E}, x AS (SELECT label, i, avg(v[i]) AS m FROM e, range(1, 65) AS r(i) GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS c FROM x GROUP BY label) SELECT key, round(sqrt({_l2('v', 'c')}), 6) AS distance FROM e JOIN c USING (label)",
        "kmeans_one_lloyd_step": f"WITH {_E}, n AS ({near}), m AS (SELECT cell, i, count(*) AS n, avg(v[i]) AS m FROM n, range(1, 65) AS r2(i) WHERE r = 1 GROUP BY cell, i) SELECT CAST(cell AS INTEGER) AS cell, max(n) AS n, round(sum(m), 6) AS total FROM m GROUP BY cell",
        "cluster_members": f"WITH {_E}, n AS ({near}) SELECT CAST(cell AS INTEGER) AS cell, count(*) AS n, min(key) AS first_key, max(key) AS last_key FROM n WHERE r = 1 GROUP BY cell",
        "qi8_quantize": f"WITH {_QI8} SELECT key, round(s, 6) AS scale, CAST(z AS BIGINT) AS zero_point, CAST(list_sum(data) AS BIGINT) AS total FROM t",
        "qi8_l2": _top(_metric("l2", "q.v", "b.v"), "u", ctes=_QI8),
        "qi8_cosine": _top(_metric("cosine", "q.v", "b.v"), "u", ctes=_QI8),
        "qi8_ip": _top(_metric("ip", "q.v", "b.v"), "u", ctes=_QI8),
        "trunc_knn": _TRUNC,
        "trunc_rerank": f"WITH {_E}, d AS (SELECT q.key AS qid, b.key AS key, q.v AS qv, b.v AS bv, {_l2('q.v[1:16]', 'b.v[1:16]')} AS t FROM e q, e b WHERE q.key % 100 = 0), c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY t, key) AS r FROM d), "
        f"x AS (SELECT qid, key, {_l2('qv', 'bv')} AS distance FROM c WHERE r <= {4 * K}), y AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, key) AS rank FROM x) SELECT qid, rank, key, round(distance, 6) AS distance FROM y WHERE rank <= {K}",
        "pq_encode_fixed_codebook": f"WITH {_CODES} SELECT key, string_agg(lower(printf('%02x', code)), '' ORDER BY s) AS code FROM near WHERE r = 1 GROUP BY key",
        "pq_sdc_l2": _top(_metric("l2", "q.v", "b.v"), "p", ctes=_CODES + ", p AS (SELECT key, flatten(list(c ORDER BY s)) AS v FROM near WHERE r = 1 GROUP BY key)"),
        "recall_at_k": f"WITH a AS ({_EXACT}), b AS ({_TRUNC}), m AS (SELECT count(*) AS total, count(b.key) AS matched FROM a LEFT JOIN b USING (qid, key)) SELECT matched, total, round(100.0 * matched / total, 6) AS recall FROM m",
        "upsert_latest": f"WITH {_E}, log AS ({_LOG}), last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, round(v[1], 6) AS first FROM e WHERE key NOT IN (SELECT key FROM last) UNION ALL SELECT key, round(value, 6) AS first FROM last WHERE op <> 'delete'",
        "set_outcome": f"WITH dead AS ({_DEAD}), log AS ({_LOG}) SELECT DISTINCT key, CASE WHEN key IN (SELECT key FROM dead) THEN 'Resurrected' WHEN key IN (SELECT vec_id FROM embeddings) THEN 'Updated' ELSE 'Inserted' END AS outcome FROM log",
        "delete_apply": f"WITH dead AS ({_DEAD}), log AS ({_LOG}) SELECT DISTINCT key, key IN (SELECT vec_id FROM embeddings) AND key NOT IN (SELECT key FROM dead) AS deleted FROM log",
        "live_counts": "SELECT count(*) AS total, count(*) FILTER (WHERE vec_id % 7 = 0) AS deleted, count(*) FILTER (WHERE vec_id % 7 <> 0) AS live, max(vec_id) + 1 AS next_id FROM embeddings",
        "merged_neighbors": f"WITH {_EDGES}, u AS (SELECT DISTINCT src, dst FROM edges) SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbors FROM u GROUP BY src",
        "reverse_edges": f"WITH {_EDGES} SELECT DISTINCT dst AS src, src AS dst FROM edges",
        "two_hop": f"WITH {_EDGES} SELECT DISTINCT a.src, b.dst FROM edges a JOIN edges b ON a.dst = b.src WHERE a.src <> b.dst",
        "compaction_candidates": f"WITH {_EDGES}, dead AS ({_DEAD}) {straight} UNION {through}",
        "hnsw_level": "SELECT vec_id AS key, CAST(floor(-ln((vec_id * 7919 % 10007 + 1) / 10007.0) / ln(16.0)) AS INTEGER) AS level FROM embeddings",
        "truth_arrays": f"WITH {_E}, d AS (SELECT q.key AS qid, b.key AS key, {_l2('q.v', 'b.v')} AS d FROM e q, e b WHERE q.key % 100 = 0 AND q.key <> b.key), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, key) AS rank FROM d) SELECT qid, string_agg(CAST(key AS VARCHAR), ',' ORDER BY rank) AS keys FROM r WHERE rank <= {K} GROUP BY qid",
        "table_query": _top(_metric("cosine", "q.v", "b.v"), where="b.key % 7 <> 0").replace("round(distance, 6)", "round(distance, 4)"),
    }
