"""python -m vecloom.cli: eval, export, migrate, insert, query over tables and files."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.knn import recall
from .plans.table import VectorTable
from .sources import files


def evaluate(spark: SparkSession, vectors: str, queries: str, truth: str, dim: int, k: int, dtype: str = "f16", metric: str = "l2_sq") -> float:
    """Recall@k (percent) of a table's search against a ground truth file."""
    base = files.read_packed(spark, vectors, dim, dtype).select(F.col("id").cast("string").alias("key"), "vector")
    q = files.read_packed(spark, queries, dim, dtype).select(F.col("id").alias("qid"), F.col("vector").alias("q"))
    expected = files.read_ground_truth(spark, truth, k).select("qid", F.explode("keys").alias("key"))
    table = VectorTable.from_df(base, {"dim": dim, "metric": metric, "dtype": dtype if dtype in ("f16", "f32") else "f32"})
    got = table.query(q, k).select("qid", F.col("key").cast("long").alias("key"))
    return recall(expected, got).first().recall


def insert_json(table: VectorTable, lines: DataFrame) -> None:
    """Inserts from rows `value` of JSON {"vectors": [{"key", "vector"}]}."""
    body = F.from_json("value", "vectors array<struct<key:string,vector:array<float>>>")
    table.insert(lines.select(F.explode(body["vectors"]).alias("v")).select("v.key", "v.vector"))


def query_json(table: VectorTable, lines: DataFrame, k: int) -> DataFrame:
    """Rows qid, value of JSON {"results": [[key, distance]]} for rows (qid, value) of JSON {"vector": [...]}."""
    q = lines.select("qid", F.from_json("value", "vector array<float>")["vector"].alias("q"))
    rows = table.query(q, k).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "key", "distance"))).alias("r"))
    pairs = F.transform("r", lambda x: F.array(F.to_json(F.array(x["key"])), x["distance"].cast("string")))
    text = F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("["), F.regexp_replace(p[0], r"^\[|\]$", ""), F.lit(","), p[1], F.lit("]"))), ",")
    return rows.select("qid", F.concat(F.lit('{"results": ['), text, F.lit("]}")).alias("value"))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="vecloom")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("eval")
    for name in ("vectors", "queries", "truth"):
        e.add_argument(name)
    e.add_argument("--dim", type=int, required=True)
    e.add_argument("-k", type=int, default=10)
    e.add_argument("--dtype", default="f16")
    e.add_argument("--metric", default="l2_sq")
    x = sub.add_parser("export")
    x.add_argument("table")
    x.add_argument("folder")
    m = sub.add_parser("migrate")
    m.add_argument("graph")
    m.add_argument("table")
    m.add_argument("--metric", default="l2_sq")
    i = sub.add_parser("insert")
    i.add_argument("table")
    i.add_argument("json")
    q = sub.add_parser("query")
    q.add_argument("table")
    q.add_argument("json")
    q.add_argument("-k", type=int, default=10)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("vecloom").getOrCreate()
    if a.command == "eval":
        print(json.dumps({"recall": evaluate(spark, a.vectors, a.queries, a.truth, a.dim, a.k, a.dtype, a.metric)}))
    elif a.command == "export":
        from .operators.mutate import with_ids

        files.write_packed(with_ids(VectorTable.open(spark, a.table).rows()), a.folder)
    elif a.command == "migrate":
        nodes, edges = files.read_graph(spark, a.graph)
        rows, linked = files.migrate_graph(nodes, edges)
        first = rows.first()
        table = VectorTable.create(spark, a.table, {"dim": len(first.vector), "metric": a.metric})
        table.insert(rows)
        linked.write.parquet(f"{a.table}/edges")
    elif a.command == "insert":
        insert_json(VectorTable.open(spark, a.table), spark.read.text(a.json))
    else:
        lines = spark.read.text(a.json).withColumn("qid", F.monotonically_increasing_id())
        for r in query_json(VectorTable.open(spark, a.table), lines, a.k).orderBy("qid").toLocalIterator():
            print(r.value)


if __name__ == "__main__":
    main()
