"""Vector files as Spark data sources and sinks: packed matrices, dim-prefixed records, ground truth, layered graph files.

Formats (all little-endian): `packed` is rows of `dim` elements without a header; `records` puts a 32-bit length before
each row; both take a dtype of f32, f16, u32, i32 or u8. Readers cut a file into ranges of whole rows that tasks read on
their own; the row's number is its id. Files are opened by path, which all executors must be able to reach.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import InvalidFile
from ..functions import vectors as V

DTYPES = {"f32": "<f4", "f16": "<f2", "u32": "<u4", "i32": "<i4", "u8": "u1"}
_INTEGER = ("u32", "i32", "u8")


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _MatrixReader(DataSourceReader):
    def __init__(self, options: dict, header: int):
        self.path, self.dtype = options["path"].removeprefix("file://"), options.get("dtype", "f32")
        self.item, self.header = np.dtype(DTYPES[self.dtype]), header
        size = os.path.getsize(self.path)
        if header:
            if size:
                with open(self.path, "rb") as f:
                    self.dim = struct.unpack("<I", f.read(4))[0]
            else:
                self.dim = 0
        else:
            self.dim = int(options["dim"])
        row = self.header + self.dim * self.item.itemsize
        if size and size % row:
            raise InvalidFile(f"{self.path}: {size} bytes aren't whole rows of {row}")
        self.row, self.rows = row, size // row if row else 0
        self.chunk = max(1, int(options.get("partition_bytes", 64 << 20)) // max(1, row))

    def partitions(self):
        return [_Range(a, min(self.rows, a + self.chunk)) for a in range(0, self.rows, self.chunk)] or [_Range(0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            step = max(1, (4 << 20) // max(1, self.row))
            for at in range(partition.start, partition.stop, step):
                n = min(step, partition.stop - at)
                f.seek(at * self.row)
                raw = np.frombuffer(f.read(n * self.row), np.uint8).reshape(n, self.row)
                if self.header and (raw[:, :4].copy().view("<u4") != self.dim).any():
                    raise InvalidFile(f"{self.path}: rows differ in length")
                values = np.ascontiguousarray(raw[:, self.header :]).view(self.item).ravel()
                kind = pa.int64() if self.dtype in _INTEGER else pa.float32()
                flat = pa.array(values.astype(np.int64 if self.dtype in _INTEGER else np.float32), kind)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.dim, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), lists], names=["id", "vector"])


class PackedSource(DataSource):
    """format("vecloom_packed"): options path, dim, dtype, partition_bytes."""

    header = 0

    @classmethod
    def name(cls) -> str:
        return "vecloom_packed"

    def schema(self) -> str:
        return f"id long, vector array<{'long' if self.options.get('dtype', 'f32') in _INTEGER else 'float'}>"

    def reader(self, schema) -> DataSourceReader:
        return _MatrixReader(dict(self.options), self.header)


class RecordSource(PackedSource):
    """format("vecloom_records"): fvecs, ivecs and bvecs files; options path, dtype, partition_bytes."""

    header = 4

    @classmethod
    def name(cls) -> str:
        return "vecloom_records"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackedSource)
    spark.dataSource.register(RecordSource)


def read_packed(spark: SparkSession, path: str, dim: int, dtype: str = "f32", **options) -> DataFrame:
    register(spark)
    return spark.read.format("vecloom_packed").options(path=path, dim=dim, dtype=dtype, **options).load()


def read_records(spark: SparkSession, path: str, dtype: str = "f32", **options) -> DataFrame:
    register(spark)
    return spark.read.format("vecloom_records").options(path=path, dtype=dtype, **options).load()


def read_ground_truth(spark: SparkSession, path: str, k: int, n_queries: int | None = None) -> DataFrame:
    """(qid, keys array<long>) from a matrix of uint32; its number of rows is checked if given."""
    if n_queries is not None and os.path.getsize(path) != 4 * k * n_queries:
        raise InvalidFile(f"{path} isn't {n_queries} rows of {k}")
    return read_packed(spark, path, k, "u32").select(F.col("id").alias("qid"), F.col("vector").alias("keys"))


def write_packed(rows: DataFrame, folder: str, dtype: str = "f32") -> None:
    """Writes rows (id, vector) as parts of ids.bin (uint64) and vecs.bin, in order of id, as rows of a Parquet folder: part,
    ids, vecs. join_packed puts the parts of a small export into the two files."""
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for n, b in enumerate(batches):
            if b.num_rows:
                v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(DTYPES[dtype])
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([n]), pa.array([np.asarray(b.column(0)).astype("<u8").tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["part", "seq", "ids", "vecs"])

    d = rows.select("id", "vector").repartitionByRange("id").sortWithinPartitions("id")
    d.mapInArrow(run, "part long, seq long, ids binary, vecs binary").write.parquet(folder)


def join_packed(spark: SparkSession, folder: str, to: str) -> None:
    """Streams an export's parts to to/ids.bin and to/vecs.bin on the driver, one part in memory at a time."""
    os.makedirs(to, exist_ok=True)
    with open(f"{to}/ids.bin", "wb") as ids, open(f"{to}/vecs.bin", "wb") as vecs:
        for r in spark.read.parquet(folder).orderBy("part", "seq").toLocalIterator():
            ids.write(r.ids)
            vecs.write(r.vecs)


def convert_records(spark: SparkSession, path: str, folder: str, dtype: str = "f32") -> None:
    """A file of records as a packed export."""
    write_packed(read_records(spark, path, dtype), folder, dtype)


# --- layered graph files written by the widespread C++ library


class GraphFile:
    """A layered graph file: header, fixed-size level-0 blocks (links, vector, label), then each node's upper links.

    Header: offset of level 0, capacity, count, bytes a block, offset of the label and of the vector in it (sizes of 8 or
    4 bytes), highest level (int32), entry node (uint32), then links a level, links at level 0, M (sizes), the level
    multiplier (double) and the construction width (size). A block's first 4 bytes are its number of links (2 bytes) and
    a deleted mark (the lowest bit of the third byte).
    """

    def __init__(self, raw: bytes):
        for word in (8, 4):
            if self._header(raw, word):
                break
        else:
            raise InvalidFile("no layered graph file")
        self._body(raw)

    def _header(self, raw: bytes, word: int) -> bool:
        s = "Q" if word == 8 else "I"
        layout = struct.Struct(f"<{6 * s}iI{3 * s}d{s}")
        if len(raw) < layout.size:
            return False
        (self.offset0, self.capacity, self.count, self.block, self.label_at, self.data_at, self.max_level, self.entry, self.links, self.links0, self.m, self.mult, self.ef) = layout.unpack_from(raw)
        self.head = layout.size
        links0 = self.links0 * 4 + 4
        self.label = self.block - self.label_at
        data = self.label_at - self.data_at
        return (
            self.offset0 == 0
            and 0 <= self.count <= self.capacity
            and self.links == self.m
            and self.links0 == 2 * self.m
            and self.m >= 2
            and self.data_at == links0
            and self.label in (4, 8)
            and data > 0
            and data % 4 == 0
            and self.head + self.count * self.block <= len(raw)
            and (self.count == 0 or (self.entry < self.count and self.max_level >= 0))
        )

    def _body(self, raw: bytes) -> None:
        n, end = self.count, self.head + self.count * self.block
        blocks = np.frombuffer(raw, np.uint8, n * self.block, self.head).reshape(n, self.block)
        self.dim = (self.label_at - self.data_at) // 4
        self.vectors = np.ascontiguousarray(blocks[:, self.data_at : self.label_at]).view("<f4")
        self.labels = np.ascontiguousarray(blocks[:, self.label_at :]).view("<u8" if self.label == 8 else "<u4").ravel().astype(np.int64)
        self.deleted = (blocks[:, 2] & 1).astype(bool)
        if len(np.unique(self.labels)) != n:
            raise InvalidFile("two nodes have one label")
        self.edges: list[tuple[int, int, int, int]] = []  # level, node, place, neighbour
        self.levels = np.zeros(n, np.int32)
        for i in range(n):
            self._links(0, i, blocks[i, : self.data_at].tobytes(), self.links0)
        at, size = end, self.links * 4 + 4
        for i in range(n):
            if at + 4 > len(raw):
                raise InvalidFile("upper links are cut off")
            total = struct.unpack_from("<I", raw, at)[0]
            at += 4
            if total % size or at + total > len(raw):
                raise InvalidFile("upper links are damaged")
            self.levels[i] = total // size
            for level in range(total // size):
                self._links(level + 1, i, raw[at + level * size : at + (level + 1) * size], self.links)
            at += total
        if at != len(raw):
            raise InvalidFile("bytes follow the last node")
        if n and int(self.levels[self.entry]) != self.max_level:
            raise InvalidFile("the entry node isn't on the highest level")

    def _links(self, level: int, node: int, block: bytes, most: int) -> None:
        n = struct.unpack_from("<H", block)[0]
        ends = struct.unpack_from(f"<{n}I", block, 4) if n <= most else None
        if ends is None or any(e >= self.count or e == node for e in ends):
            raise InvalidFile(f"node {node} has impossible links on level {level}")
        self.edges += [(level, node, k, e) for k, e in enumerate(ends)]


def write_graph(path: str, labels, vectors, edges, levels, deleted, entry: int, m: int, ef: int = 200, word: int = 8) -> None:
    """Writes a layered graph file; edges are (level, node, place, neighbour)."""
    n, dim = vectors.shape
    links0, links = 2 * m, m
    data_at = links0 * 4 + 4
    label_at = data_at + 4 * dim
    s = "Q" if word == 8 else "I"
    by: dict[tuple[int, int], list[int]] = {}
    for level, node, _, end in sorted(edges):
        by.setdefault((level, node), []).append(end)
    with open(path, "wb") as f:
        f.write(struct.pack(f"<{6 * s}iI{3 * s}d{s}", 0, max(n, 1), n, label_at + 8, label_at, data_at, max(levels, default=-1), entry, links, links0, m, 1 / np.log(m), ef))
        for i in range(n):
            ends = by.get((0, i), [])
            f.write(struct.pack("<HBB", len(ends), int(deleted[i]), 0) + struct.pack(f"<{links0}I", *ends, *[0] * (links0 - len(ends))))
            f.write(np.asarray(vectors[i], "<f4").tobytes() + struct.pack("<Q", int(labels[i])))
        for i in range(n):
            f.write(struct.pack("<I", levels[i] * (links * 4 + 4)))
            for level in range(1, levels[i] + 1):
                ends = by.get((level, i), [])
                f.write(struct.pack("<HH", len(ends), 0) + struct.pack(f"<{links}I", *ends, *[0] * (links - len(ends))))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (id, key, level, deleted, vector) and edges (level, src, pos, dst) of a layered graph file; it is read by
    one task, as the format has no places to cut it."""
    raw = spark.read.format("binaryFile").load(path).select("content")

    def nodes(batches):
        for b in batches:
            for content in b.column(0):
                g = GraphFile(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(g.count)), pa.array(g.labels), pa.array(g.levels), pa.array(g.deleted), pa.array(list(g.vectors), pa.list_(pa.float32()))], names=["id", "key", "level", "deleted", "vector"])

    def edges(batches):
        for b in batches:
            for content in b.column(0):
                e = np.array(GraphFile(content.as_py()).edges, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].astype(np.int32)), *(pa.array(e[:, k]) for k in (1, 2, 3))], names=["level", "src", "pos", "dst"])

    return raw.mapInArrow(nodes, "id long, key long, level int, deleted boolean, vector array<float>"), raw.mapInArrow(edges, "level int, src long, pos long, dst long")


def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")


def _read_meta(spark: SparkSession, path: str, kind: str) -> dict:
    try:
        meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    except Exception as e:
        raise InvalidFile(f"{path} isn't a stored {kind}") from e
    if meta.get("kind") != kind or meta.get("version") != VERSION:
        raise InvalidFile(f"{path}: {meta.get('kind')} of version {meta.get('version')}, not {kind} of version {VERSION}")
    return meta


#: Version of the stored forms below.
VERSION = 1


def save_graph_tables(nodes: DataFrame, edges: DataFrame, path: str, m: int = 16, entry: int | None = None, dtype: str = "f32") -> None:
    """Writes nodes (id, vector, and what else they have) and edges (level, src, pos, dst), and last what they are: version,
    element type, dimension, m, entry node and highest level."""
    nodes.write.parquet(f"{path}/nodes")
    edges.write.parquet(f"{path}/edges")
    spark = nodes.sparkSession
    nodes = spark.read.parquet(f"{path}/nodes")
    level = F.max("level") if "level" in nodes.columns else F.lit(None).cast("int")
    found = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("dim"), level.alias("top")).first()
    if entry is None and found.n:
        order = [F.desc("level")] if "level" in nodes.columns else []
        entry = nodes.orderBy(*order, "id").first().id
    _write_meta(spark, path, {"kind": "graph", "version": VERSION, "dtype": dtype, "count": found.n, "dim": found.dim, "m": m, "entry": entry, "max_level": found.top})


def graph_meta(spark: SparkSession, path: str) -> dict:
    return _read_meta(spark, path, "graph")


def load_graph_tables(spark: SparkSession, path: str, max_edges: int | None = None, m: int | None = None, dtype: str | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges, checked: version, element type and m as expected, all vectors of the stored dimension, the stored number
    of nodes, the entry on the highest level, no self-edges, no missing ends, no repeats within a level, none over a level's
    bound (max_edges, or m and at level 0 twice that)."""
    meta = graph_meta(spark, path)
    for name, want in (("m", m), ("dtype", dtype)):
        if want is not None and meta[name] != want:
            raise InvalidFile(f"{path}: {name} is {meta[name]}, not {want}")
    nodes, edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    bad = nodes.count() != meta["count"] or nodes.where(F.size("vector") != F.lit(meta["dim"])).limit(1).count()
    bad = bad or nodes.count() != nodes.select("id").distinct().count()
    if meta["entry"] is not None:
        on = nodes.where(F.col("id") == meta["entry"])
        bad = bad or not (on.where(F.col("level") == meta["max_level"]) if meta["max_level"] is not None else on).limit(1).count()
    if meta["max_level"] is not None:
        bad = bad or nodes.agg(F.max("level")).first()[0] != meta["max_level"] or edges.where(F.col("level") > meta["max_level"]).limit(1).count()
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    bad = bad or edges.where("src = dst").limit(1).count() or ends.join(nodes, "id", "left_anti").limit(1).count()
    bad = bad or edges.groupBy("level", "src", "dst").count().where("count > 1").limit(1).count()
    most = F.lit(max_edges) if max_edges is not None else F.when(F.col("level") == 0, 2 * meta["m"]).otherwise(meta["m"])
    bad = bad or edges.groupBy("level", "src").count().where(F.col("count") > most).limit(1).count()
    if bad:
        raise InvalidFile(f"{path}: the graph is damaged")
    return nodes, edges


def save_vectors(rows: DataFrame, path: str, dtype: str = "f32") -> None:
    """Writes rows (key, vector) as they are stored: f32, f16 and bf16 as arrays of rounded floats, qi8 as 8-bit structs, which
    vectors may be already. All have one dimension. Repeated keys are refused."""
    kind = rows.schema["vector"].dataType.simpleString()
    v = F.col("vector")
    if dtype == "qi8":
        v = v if kind.startswith("struct") else V.qi8_quantize(v)
    else:
        v = V.CASTS[dtype](v)
    rows.select("key", v.alias("vector")).write.parquet(f"{path}/rows")
    d = rows.sparkSession.read.parquet(f"{path}/rows")
    size = F.size("vector.data") if dtype == "qi8" else F.size("vector")
    found = d.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("key").alias("keys"), F.min(size).alias("low"), F.max(size).alias("high")).first()
    if found.n and (found.low != found.high or found.n != found.keys):
        raise InvalidFile("vectors of one dimension and different keys are expected")
    _write_meta(rows.sparkSession, path, {"kind": "vectors", "version": VERSION, "dtype": dtype, "dim": found.high, "count": found.n})


def load_vectors(spark: SparkSession, path: str, dtype: str | None = None, dim: int | None = None) -> DataFrame:
    """Rows (key, vector) of a stored vector table; its element type and dimension are checked where given."""
    meta = _read_meta(spark, path, "vectors")
    for name, want in (("dtype", dtype), ("dim", dim)):
        if want is not None and meta[name] != want:
            raise InvalidFile(f"{path}: {name} is {meta[name]}, not {want}")
    rows = spark.read.parquet(f"{path}/rows")
    if rows.count() != meta["count"]:
        raise InvalidFile(f"{path}: {meta['count']} rows are expected")
    return rows


def migrate_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A layered graph as a flat one: live rows (key string, vector), and edges (src, neighbors) over all levels by key."""
    names = nodes.select("id", F.col("key").cast("string").alias("key"))
    flat = edges.select("src", "dst").distinct()
    flat = flat.join(names.select(F.col("id").alias("src"), F.col("key").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("key").alias("b")), "dst")
    linked = flat.groupBy(F.col("a").alias("src")).agg(F.sort_array(F.collect_set("b")).alias("neighbors"))
    return nodes.where("not deleted").select(F.col("key").cast("string").alias("key"), "vector"), linked
