"""A corpus from documents to token files: the stages, and run().

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns a DataFrame; what it
returns is written as Parquet and read again as the next stage's docs.

All stages: null text counts as empty; rows with equal or null doc_id are rows like any other; very long texts are read
whole; an empty table gives an empty one; extra columns, whatever their names, are passed on by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm.common import drop_path, file_names, stored, tables
from vecloom.llm.decontaminate import without_benchmark
from vecloom.llm.mixing import mixed_documents
from vecloom.llm.quality import keep_quality
from vecloom.llm.simhash import one_of_each
from vecloom.llm.tokenids import read_token_ids, token_ids


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. Null and empty texts fail them; repeated rows share one verdict, and all stay or
    go; a score equal to the threshold passes. Labels without an id are passed over."""
    return keep_quality(docs, tables(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id; null ids come last. Texts without words
    are one group. Of repeated rows and rows of equal ids one stays, whichever was written first."""
    return one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item. Null and empty texts have none and stay; repeated rows all stay or all
    go; items that are null or empty match nothing."""
    return without_benchmark(docs, tables(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights; a document that is taken several times has several rows. Null is a source,
    the last one. Rows with equal ids and texts share a fate. Sources without words are left out."""
    return mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token ids in files at `path`, and per row of docs where they are: doc_id, start, n_tokens, ids_crc32. By ascending
    doc_id, null first; equal ids by text. A null or empty text has its end id only."""
    return token_ids(docs, path)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokenize", tokenize)]

#: Fingerprints and token ids can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, out: str | None = None) -> DataFrame:
    """All stages in order, applied to documents.

    out: a folder that keeps every stage's table and the token files, as <number>-<stage>. A stage whose table is whole there
    is read instead of run, so a run that was cut short goes on from its last finished stage. Without it, tables are in
    the cluster's shared folder until the application ends.
    """
    docs = tables(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        path = f"{out.rstrip('/')}/{n}-{name}" if out else None
        done = path is not None and "_SUCCESS" in file_names(spark, path)
        if path and not done:
            drop_path(spark, path)
        if stage is tokenize:
            kind = docs.schema["doc_id"].dataType.simpleString()
            return read_token_ids(spark, path, kind) if done else tokenize(spark, docs, sf_dir, path)
        if path is None:
            docs = stored(stage(spark, docs, sf_dir), name)
            continue
        schema = docs.schema
        if not done:
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
    raise AssertionError("the last stage writes the tokens")
