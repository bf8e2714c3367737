"""Changes, tables, files, streams, the command line and the registered queries."""

import json
import os
import struct
import subprocess
import sys

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom import cli
from vecloom.errors import IndexFull, InvalidConfig, InvalidFile, KeyAlreadyExists, TableExists, TableMissing
from vecloom.functions import vectors as V
from vecloom.operators import graph, mutate
from vecloom.operators.clusters import kmeans_all
from vecloom.operators.knn import recall
from vecloom.plans.table import Config, VectorTable
from vecloom.sources import files
from vecloom.streaming.mutations import follow


def rows(spark, items):
    return spark.createDataFrame(items, "key string, vector array<float>")


def state(table):
    return {r.key: list(r.vector) for r in table.rows().collect()}


def test_config():
    assert Config.of({"dim": 4}).max_edges == 64 and Config.of({"dim": 4, "metric": "ip"}).metric == "inner_product"
    for bad in ({}, {"dim": 0}, {"dim": 4, "what": 1}, {"dim": 4, "dtype": "f64"}, {"dim": 4, "compression_mode": "zip"}):
        with pytest.raises(InvalidConfig):
            Config.of(bad)


def test_table_life(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(TableMissing):
        VectorTable.open(spark, path)
    t = VectorTable.create(spark, path, {"dim": 2, "compaction_threshold_deletes": 100})
    with pytest.raises(TableExists):
        VectorTable.create(spark, path, {"dim": 2})
    q = spark.createDataFrame([(1, [0.0, 0.0])], "qid long, q array<float>")
    assert t.query(q, 3).count() == 0
    t.insert(rows(spark, [("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [float("nan"), 3.0])]))
    t.insert(rows(spark, [("a", [5.0, 0.0])]))
    t.delete(spark.createDataFrame([("b",), ("nobody",)], "key string"))
    want = {"a": [5.0, 0.0], "c": [0.0, 3.0]}
    assert state(t) == want and t.deleted() == 2
    t = VectorTable.open(spark, path)
    assert [r.key for r in t.query(q, 5).orderBy("rank").collect()] == ["c", "a"]
    assert [r.key for r in t.query(q, 5, where=F.col("key") != "c").collect()] == ["a"]
    t.compact()
    assert state(VectorTable.open(spark, path)) == want and t.generation == 1 and t.deleted() == 0
    t.compact()
    t.insert(rows(spark, [("b", [9.0, 9.0])]))
    assert state(t) == want | {"b": [9.0, 9.0]}
    assert {r.key: r.vector for r in t.get(spark.createDataFrame([("b",), ("z",)], "key string")).collect()} == {"b": [9.0, 9.0], "z": None}
    with pytest.raises(Exception, match="elements"):
        VectorTable.from_df(rows(spark, [("x", [1.0])]), {"dim": 2}).count()


def test_compaction_loses_nothing(spark, tmp_path, monkeypatch):
    """What another handle writes while a compaction runs stays, a second compaction at once gives up, queries on the old
    generation still have their files, and a batch that isn't whole doesn't count."""
    path = str(tmp_path / "t")
    a = VectorTable.create(spark, path, {"dim": 1})
    b = VectorTable.open(spark, path)
    a.insert(rows(spark, [(k, [1.0]) for k in "abc"]))
    held = b.rows()
    publish = type(a._files).publish

    def slow(self, text, *parts):
        if parts == ("current", "1"):
            monkeypatch.setattr(type(a._files), "publish", publish)
            b.insert(rows(spark, [("d", [2.0]), ("a", [3.0])]))
            b.delete(spark.createDataFrame([("b",)], "key string"))
        return publish(self, text, *parts)

    monkeypatch.setattr(type(a._files), "publish", slow)
    assert a.compact() == {"rows": 3, "deleted": 0, "changed": 3, "touched": 0}
    want = {"a": [3.0], "c": [1.0], "d": [2.0]}
    assert state(a) == state(VectorTable.open(spark, path)) == want and held.count() == 3 and a.is_deleted("b") and not a.is_deleted("a")
    os.makedirs(f"{path}/log/b000000000099-x")
    assert state(a) == want

    def late(self, text, *parts):
        if parts == ("current", "2"):
            monkeypatch.setattr(type(a._files), "publish", publish)
            assert b.compact()["deleted"] == 1
        return publish(self, text, *parts)

    monkeypatch.setattr(type(a._files), "publish", late)
    assert a.compact() is None and a.generation == 2 and state(a) == want
    assert len(os.listdir(f"{path}/base")) == 2
    a.insert(rows(spark, [("e", [5.0])]))
    a.compact()
    assert state(a) == want | {"e": [5.0]} and sorted(x for x in os.listdir(f"{path}/current") if x.isdigit()) == ["2", "3"]


@pytest.mark.parametrize("kind", ["graph", "cells"])
def test_table_with_an_index(spark, tmp_path, kind):
    """Searches by an index through inserts, updates, deletes and compactions: recall against a scan, and no dead rows."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(500, 6))
    path = str(tmp_path / "t")
    t = VectorTable.create(spark, path, {"dim": 6, "max_edges": 12, "max_add_edges": 4, "query_search_list_cap": 48})
    t.insert(rows(spark, [(f"k{n}", x.tolist()) for n, x in enumerate(v[:400])]))
    t.build_index(kind, cells=8)
    q = spark.createDataFrame([(n, v[n].tolist()) for n in range(0, 500, 25)], "qid long, q array<float>")

    def check(least):
        t = VectorTable.open(spark, path)
        truth, got = t.query(q, 5, exact=True), t.query(q, 5, nprobe=4).persist()
        assert got.join(t.keys(), "key", "left_anti").count() == 0 and got.groupBy("qid").count().where("count != 5").count() == 0
        assert recall(truth, got).first().recall >= least
        got.unpersist()

    check(90)
    t.insert(rows(spark, [(f"k{n}", x.tolist()) for n, x in enumerate(v) if n >= 380]))
    t.delete(spark.createDataFrame([(f"k{n}",) for n in range(0, 400, 7)], "key string"))
    check(90)
    done = t.compact()
    assert done["deleted"] == 58 and done["rows"] == 442 and (done["touched"] > 50) == (kind == "graph")
    check(90)
    odd = t.query(q, 5, where=F.col("key").endswith("1"))
    assert {r.key[-1] for r in odd.collect()} == {"1"} and odd.count() == 100
    if kind == "graph":
        index = t._current()["index"]
        nodes, edges = t._read("index", index["name"], "nodes"), t._read("index", index["name"], "edges")
        assert tuple(graph.check_graph(edges, nodes, 16).first()) == (0, 0, 0, 0) and t.entry_key() in {r.key for r in t.keys().collect()}
    t.delete(t.keys())
    assert t.query(q, 3).count() == 0
    t.compact()
    assert t.query(q, 3).count() == 0 and t.count() == 0


def test_small_graphs_are_mended_in_memory(spark, tmp_path, monkeypatch):
    """A compaction mends a small graph in memory, by few jobs, to the same edges as by joins."""
    rng = np.random.default_rng(21)
    v = rng.normal(size=(420, 6))
    made, jobs, metric = [], [], "cosine"
    for most in (graph.WHOLE_ROWS, 0):
        t = VectorTable.create(spark, str(tmp_path / f"t{most}"), {"dim": 6, "metric": metric, "max_edges": 8, "max_add_edges": 2, "beam_width": 6, "update_search_list_cap": 30})
        t.insert(rows(spark, [(f"k{n}", x.tolist()) for n, x in enumerate(v[:300])]))
        t.build_index("graph")
        t.insert(rows(spark, [(f"k{n}", x.tolist()) for n, x in enumerate(v) if n >= 280]))
        t.delete(spark.createDataFrame([(f"k{n}",) for n in range(0, 300, 6)], "key string"))
        monkeypatch.setattr(graph, "WHOLE_ROWS", most)
        spark.sparkContext.setJobGroup(str(tmp_path / f"{most}"), "")
        done = t.compact()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(tmp_path / f"{most}"))))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        index = t._current()["index"]
        nodes, edges = t._read("index", index["name"], "nodes"), t._read("index", index["name"], "edges")
        assert tuple(graph.check_graph(edges, nodes, 10).first()) == (0, 0, 0, 0) and nodes.count() == done["rows"] == 370
        made.append((done, t.entry_key(), sorted(tuple(r) for r in edges.collect())))
    assert made[0] == made[1]
    assert jobs[0] <= 40 < jobs[1]


def test_table_by_graph_breaks_ties_by_number(spark, tmp_path):
    """Copies of a vector come in the order of their keys as numbers, as in the query's SQL."""
    from vecloom import queries

    spark.range(40).selectExpr("id as vec_id", "transform(sequence(1, 64), x -> float(x)) as embedding", "1 as label").write.parquet(str(tmp_path / "embeddings.parquet"))
    keys = [r.key for r in queries.table_by_graph(spark, str(tmp_path)).orderBy("rank").collect()]
    assert len(keys) == 10 and keys == sorted(keys)


def test_stored_codes(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    t = VectorTable.create(spark, str(tmp_path / "t"), {"dim": 8, "pq_subspaces": 4, "compression_threshold": 250})
    t.insert(rows(spark, [(f"k{n}", x.tolist()) for n, x in enumerate(v[:200])]))
    assert not t.compressed() and t.compact()["rows"] == 200 and not t.compressed()
    t.insert(rows(spark, [(f"k{n}", x.tolist()) for n, x in enumerate(v) if n >= 200]))
    assert t.compressed() and t.compact()["rows"] == 300 and len(os.listdir(tmp_path / "t" / "codes")) == 1
    t.insert(rows(spark, [("k3", (v[3] + 50).tolist()), ("new", v[3].tolist())]))
    q = spark.createDataFrame([(n, v[n].tolist()) for n in range(5)], "qid long, q array<float>")
    assert [r.key for r in t.search(q, 1).orderBy("qid").collect()] == ["k0", "k1", "k2", "new", "k4"]


def test_deletes_compact(spark, tmp_path):
    t = VectorTable.create(spark, str(tmp_path / "t"), {"dim": 1, "compaction_threshold_deletes": 2})
    t.insert(rows(spark, [(k, [1.0]) for k in "abc"]))
    t.delete(spark.createDataFrame([("a",), ("b",)], "key string"))
    assert t.generation == 1 and set(state(t)) == {"c"}


def test_compressed_table(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(300, 8))
    t = VectorTable.create(spark, str(tmp_path / "t"), {"dim": 8, "pq_subspaces": 4, "trunc_dims": 4})
    t.insert(rows(spark, [(f"k{n}", x.tolist()) for n, x in enumerate(v)]))
    q = spark.createDataFrame([(n, v[n].tolist()) for n in range(5)], "qid long, q array<float>")
    for _ in range(2):  # trains, then reads what it stored
        assert [r.key for r in t.query_compressed(q, 1).orderBy("qid").collect()] == [f"k{n}" for n in range(5)]
    assert [r.key for r in t.search(q, 1).orderBy("qid").collect()] == [f"k{n}" for n in range(5)]
    t.config.compression_threshold = 100
    assert t.compressed() and t.search(q, 1).count() == 5
    t.config.compression_threshold = 1000
    t.config.compression_mode = "trunc"
    assert t.query_compressed(q, 2).count() == 10 and not t.compressed()
    assert [r.key for r in t.ivf(8).search(q, 1, 8).orderBy("qid").collect()] == [f"k{n}" for n in range(5)]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from(["insert", "delete"]), st.integers(0, 6), st.integers(-9, 9)), max_size=25))
def test_upsert_is_like_a_dict(spark, ops):
    model = {k: 0 for k in range(0, 7, 2)}
    base = spark.createDataFrame([(k, [0.0]) for k in model], "key long, vector array<double>")
    log = spark.createDataFrame([(n, op, k, [float(x)]) for n, (op, k, x) in enumerate(ops)], "seq long, op string, key long, vector array<double>")
    for op, k, x in ops:
        model.pop(k, None) if op == "delete" else model.__setitem__(k, x)
    assert {r.key: r.vector[0] for r in mutate.upsert(base, log).collect()} == model


def test_outcomes(spark):
    base = spark.createDataFrame([(k, [0.0]) for k in (1, 2, 3)], "key long, vector array<double>")
    dead = spark.createDataFrame([(2,)], "key long")
    new = spark.createDataFrame([(2, [1.0]), (3, [1.0]), (4, [1.0])], "key long, vector array<double>")
    assert {r.key: r.outcome for r in mutate.set_outcomes(base, dead, new).collect()} == {2: "Resurrected", 3: "Updated", 4: "Inserted"}
    assert {r.key: r.deleted for r in mutate.delete_outcomes(base, dead, new).collect()} == {2: False, 3: True, 4: False}
    with pytest.raises(KeyAlreadyExists):
        mutate.insert_new(base, new, dead)
    assert mutate.insert_new(base, new.where("key = 4")).count() == 4
    assert tuple(mutate.counts(base.withColumn("id", F.col("key")), dead).first()) == (3, 1, 2, 4)
    got = mutate.with_ids(spark.createDataFrame([(f"{k:04}",) for k in range(500)], "key string").repartition(7)).orderBy("key")
    assert [r.id for r in got.collect()] == list(range(1, 501))


def test_stream(spark, tmp_path):
    t = VectorTable.create(spark, str(tmp_path / "t"), {"dim": 1})
    schema = "seq long, op string, key string, vector array<float>"
    src = str(tmp_path / "src")
    os.mkdir(src)
    changes = spark.readStream.schema(schema).parquet(src)
    for batch in ([(1, "insert", "a", [1.0]), (2, "insert", "b", [2.0]), (3, "insert", "a", [3.0])], [(4, "delete", "b", None), (5, "set", "c", [4.0])]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        follow(t, changes, str(tmp_path / "ck")).awaitTermination()
    assert state(t) == {"a": [3.0], "c": [4.0]}


# --- files


def test_matrix_files(spark, tmp_path):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(50, 6)).astype(np.float32)
    v.tofile(tmp_path / "v.f32")
    v.astype(np.float16).tofile(tmp_path / "v.f16")
    got = sorted(files.read_packed(spark, str(tmp_path / "v.f32"), 6, partition_bytes=100).collect())
    assert [r.id for r in got] == list(range(50)) and np.array_equal(np.array([r.vector for r in got], np.float32), v)
    got = sorted(files.read_packed(spark, str(tmp_path / "v.f16"), 6, "f16").collect())
    assert np.array_equal(np.array([r.vector for r in got], np.float32), v.astype(np.float16).astype(np.float32))
    with open(tmp_path / "v.fvecs", "wb") as f:
        for x in v:
            f.write(struct.pack("<I", 6) + x.tobytes())
    got = sorted(files.read_records(spark, str(tmp_path / "v.fvecs"), partition_bytes=64).collect())
    assert np.array_equal(np.array([r.vector for r in got], np.float32), v)
    files.convert_records(spark, str(tmp_path / "v.fvecs"), str(tmp_path / "out"))
    files.join_packed(spark, str(tmp_path / "out"), str(tmp_path / "flat"))
    assert (tmp_path / "flat/vecs.bin").read_bytes() == v.tobytes()
    assert np.fromfile(tmp_path / "flat/ids.bin", "<u8").tolist() == list(range(50))
    (tmp_path / "odd").write_bytes(b"abc")
    with pytest.raises(Exception, match="whole rows"):
        files.read_packed(spark, str(tmp_path / "odd"), 6).collect()
    with pytest.raises(InvalidFile):
        files.read_ground_truth(spark, str(tmp_path / "v.f32"), 3, 7)


@pytest.fixture
def graph_file(tmp_path):
    rng = np.random.default_rng(1)
    n, m = 32, 4
    v = np.array([[10 * i, 10 * i + 1, 10 * i + 2, 10 * i + 3] for i in range(n)], np.float32)
    levels = [2 if i == 7 else 1 if i % 5 == 2 else 0 for i in range(n)]
    edges = [(0, i, p, (i + p + 1) % n) for i in range(n) for p in range(3)]
    upper = [i for i in range(n) if levels[i]]
    edges += [(1, i, 0, upper[(k + 1) % len(upper)]) for k, i in enumerate(upper)]
    dead = [i == 5 for i in range(n)]
    path = str(tmp_path / "g.bin")
    files.write_graph(path, rng.permutation(n) + 100, v, edges, levels, dead, 7, m)
    return path, v, edges, levels, dead


def test_graph_file(spark, graph_file, tmp_path):
    path, v, edges, levels, dead = graph_file
    nodes, e = files.read_graph(spark, path)
    got = sorted(nodes.collect())
    assert [list(r.vector) for r in got] == v.tolist() and [r.level for r in got] == levels and [r.deleted for r in got] == dead
    assert sorted(map(tuple, e.collect())) == sorted(edges)
    files.save_graph_tables(nodes, e, str(tmp_path / "tables"))
    assert files.load_graph_tables(spark, str(tmp_path / "tables"), 8)[1].count() == len(edges)
    files.save_graph_tables(nodes, e.union(e.limit(1)), str(tmp_path / "bad"))
    with pytest.raises(InvalidFile):
        files.load_graph_tables(spark, str(tmp_path / "bad"))
    flat, linked = files.migrate_graph(nodes, e)
    assert flat.count() == 31 and linked.count() == 32


def test_stored_graphs_and_vectors_are_checked(spark, tmp_path):
    nodes = spark.createDataFrame([(n, f"k{n}", 1 if n == 4 else 0, [float(n), 0.0]) for n in range(6)], "id long, key string, level int, vector array<float>")
    edges = spark.createDataFrame([(0, n, 0, (n + 1) % 6) for n in range(6)], "level int, src long, pos int, dst long")
    path = str(tmp_path / "g")
    files.save_graph_tables(nodes, edges, path, m=2)
    assert files.graph_meta(spark, path) == {"kind": "graph", "version": 1, "dtype": "f32", "count": 6, "dim": 2, "m": 2, "entry": 4, "max_level": 1}
    assert files.load_graph_tables(spark, path, m=2, dtype="f32")[0].count() == 6
    for wrong in ({"m": 3}, {"dtype": "f16"}, {"max_edges": 0}):
        with pytest.raises(InvalidFile):
            files.load_graph_tables(spark, path, **wrong)
    with pytest.raises(InvalidFile):
        files.load_graph_tables(spark, str(tmp_path / "none"))
    nodes.where("id < 5").write.mode("overwrite").parquet(f"{path}/nodes")
    with pytest.raises(InvalidFile):
        files.load_graph_tables(spark, path)
    meta = next(p for p in (tmp_path / "g" / "meta").iterdir() if p.name.startswith("part"))
    meta.write_text(meta.read_text().replace('"version": 1', '"version": 9'))
    (tmp_path / "g" / "meta" / f".{meta.name}.crc").unlink(missing_ok=True)
    with pytest.raises(InvalidFile, match="version 9"):
        files.graph_meta(spark, path)
    base = nodes.select("key", "vector")
    for dtype in ("f32", "f16", "bf16", "qi8"):
        files.save_vectors(base, str(tmp_path / dtype), dtype)
        got = files.load_vectors(spark, str(tmp_path / dtype), dtype, 2)
        value = V.qi8_dequantize("vector") if dtype == "qi8" else F.col("vector")
        assert {r.key: round(r.v[0], 1) for r in got.select("key", value.alias("v")).collect()} == {f"k{n}": float(n) for n in range(6)}
        with pytest.raises(InvalidFile):
            files.load_vectors(spark, str(tmp_path / dtype), dtype, 3)
    with pytest.raises(InvalidFile):
        files.save_vectors(base.union(base), str(tmp_path / "twice"))


def test_kmeans_on_whole_data(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=(40, 3)) + c for c in (0, 20, 40)])
    base = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)], "key long, vector array<double>")
    cells, c, steps = kmeans_all(base, v[[0, 1, 80]])
    near = np.array([[((a - b) ** 2).sum() for b in c] for a in v]).argmin(axis=1)
    assert {r.key: r.cell for r in cells.collect()} == dict(enumerate(near.tolist())) and 0 < steps < 50
    for k in set(near.tolist()):
        assert np.allclose(c[k], v[near == k].mean(axis=0))


def test_full_index(spark):
    base = spark.createDataFrame([(1, [0.0])], "key long, vector array<double>")
    with pytest.raises(IndexFull):
        mutate.insert_new(base, base.selectExpr("key + 1 as key", "vector"), capacity=1)


def test_damaged_graph_files(graph_file):
    path, *_ = graph_file
    raw = open(path, "rb").read()
    files.GraphFile(raw)
    for bad in (b"", raw[:50], raw[:-1], raw + b"x", b"\1" + raw[1:], raw[:96] + b"\xff\xff" + raw[98:]):
        with pytest.raises(InvalidFile):
            files.GraphFile(bad)


def test_commands(spark, graph_file, tmp_path, capsys):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 4)).astype(np.float16)
    v.tofile(tmp_path / "v")
    v[:9].tofile(tmp_path / "q")
    d = ((v[:9, None].astype(float) - v[None].astype(float)) ** 2).sum(axis=2)
    d.argsort(axis=1, kind="stable")[:, :3].astype("<u4").tofile(tmp_path / "truth")
    assert cli.evaluate(spark, str(tmp_path / "v"), str(tmp_path / "q"), str(tmp_path / "truth"), 4, 3) == 100.0
    t = str(tmp_path / "migrated")
    cli.main(["migrate", graph_file[0], t])
    (tmp_path / "in.json").write_text(json.dumps({"vectors": [{"key": "new \"x\"", "vector": [1, 2, 3, 4]}]}))
    cli.main(["insert", t, str(tmp_path / "in.json")])
    (tmp_path / "q.json").write_text(json.dumps({"vector": [1, 2, 3, 4]}))
    cli.main(["query", t, str(tmp_path / "q.json"), "-k", "2"])
    got = json.loads(capsys.readouterr().out.strip().splitlines()[-1])["results"]
    assert got[0] == ['new "x"', 0.0] and len(got) == 2
    cli.main(["export", t, str(tmp_path / "export")])
    assert spark.read.parquet(str(tmp_path / "export")).selectExpr("sum(length(ids))").first()[0] == 8 * 32


# --- registered queries


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in ("embeddings", "events"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_queries_match_their_sql(spark, duck):
    from vecloom.queries import oracle_sql, queries

    found, sql = queries(), oracle_sql()
    assert set(sql) <= set(found)
    for name, query in found.items():
        got = query(spark, SF)
        if name not in sql:
            assert got.count() > 0, name
            continue
        want = duck.execute(sql[name]).df()
        got = got.toPandas()
        assert sorted(got.columns) == sorted(want.columns), name
        a, b = (sorted(map(repr, x[sorted(x.columns)].itertuples(index=False, name=None))) for x in (got, want))
        assert [x.replace("-0.0", "0.0") for x in a] == [x.replace("-0.0", "0.0") for x in b], name
    assert found["ivf_recall"](spark, SF).first().enough  # 90 or more


def test_entry_without_corpus_operators(tmp_path):
    """Everything else works when the subpackage and the pipeline are gone."""
    root = os.path.dirname(os.path.dirname(__file__))
    for name in os.listdir(root):
        if name not in (".git", "corpus_pipeline.py", "vecloom"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "vecloom")
    for name in os.listdir(f"{root}/vecloom"):
        if name != "llm":
            os.symlink(f"{root}/vecloom/{name}", tmp_path / "vecloom" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'knn_l2' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"})


def test_kmeans_goes_on_to_its_end(spark):
    """A chain of points that takes over 50 steps, from several tasks."""
    rng = np.random.default_rng(0)
    v = np.sort(rng.uniform(0, 1, 3000))[:, None]
    base = spark.createDataFrame([(n, x.tolist()) for n, x in enumerate(v)], "key long, vector array<double>").repartition(7, "key").cache()
    _, c, steps = kmeans_all(base, v[:8], None)
    near = ((v - c[:, 0]) ** 2).argmin(axis=1)
    assert steps > 50 and np.allclose(c[:, 0], [v[near == k].mean() for k in range(8)], rtol=0, atol=1e-12)
