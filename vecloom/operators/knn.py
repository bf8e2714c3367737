"""Exact nearest neighbours: queries are broadcast in blocks of bounded size, each partition keeps its best k.

Result rows: qid, rank (long, from 1), key, distance (double). Ties are broken by key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import DimensionMismatch
from ..functions import vectors as V

#: Bytes of query vectors that are broadcast at once, of distances held at once, and of vectors compared exactly at once.
QUERY_BYTES, CELL_BYTES, PAIR_BYTES = 16 << 20, 32 << 20, 64 << 20


def matrix(column: pa.Array | pa.ChunkedArray, dims: int | None = None) -> np.ndarray:
    """(rows, dims) doubles of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = len(values) // n if n else dims or 0
    lengths = np.diff(column.offsets.to_numpy())
    if n and (lengths != (dims or width)).any():
        raise DimensionMismatch(dims or width, int(lengths[lengths != (dims or width)][0]))
    return values.reshape(n, width)


def _fast(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances by matrix product, right to rounding."""
    d = q @ b.T
    if metric == "inner_product":
        return 1 - d
    nq, nb = (q * q).sum(axis=1)[:, None], (b * b).sum(axis=1)[None, :]
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((nq == 0) | (nb == 0), 1.0, 1 - d / np.sqrt(nq * nb))
    return np.maximum(nq + nb - 2 * d, 0)


def _error(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """What `_fast` may be off by at most, for each pair (a bound of rounding and of cancellation)."""
    unit = 4 * np.finfo(np.float64).eps * (q.shape[1] + 8)
    if metric == "cosine":
        return np.full((1, 1), unit)
    with np.errstate(over="ignore", invalid="ignore"):
        return unit * ((q * q).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] + 1)


def _pairs(q: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray, metric: str) -> np.ndarray:
    """Exact distances of pairs, some at a time."""
    step = max(1, PAIR_BYTES // (8 * max(1, q.shape[1])))
    parts = [exact(q[row[at : at + step]], b[col[at : at + step]], metric) for at in range(0, len(row), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def exact(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of paired rows, element by element: equal vectors get equal distances. Not a number where an element isn't."""
    with np.errstate(over="ignore", invalid="ignore"):
        return _exact(q, b, metric)


def _exact(q: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric in ("l2_sq", "euclidean"):
        d = ((q - b) ** 2).cumsum(axis=1)[:, -1] if q.shape[1] else np.zeros(len(q))
        return np.sqrt(d) if metric == "euclidean" else d
    d = (q * b).cumsum(axis=1)[:, -1] if q.shape[1] else np.zeros(len(q))
    if metric == "inner_product":
        return 1 - d
    nq, nb = (q * q).cumsum(axis=1)[:, -1], (b * b).cumsum(axis=1)[:, -1]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((nq == 0) | (nb == 0), 1.0, 1 - d / np.sqrt(nq * nb))


class TopK:
    """The best k of each query over the rows seen so far. Infinite distances come after all others, then those that aren't
    numbers; ties are broken by key."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric = queries, k, metric
        self.row, self.dist, self.keys = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, keys: np.ndarray, base: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """allowed: (queries, rows) of those to look at; all by default."""
        step = max(1, CELL_BYTES // (8 * max(1, len(self.q))))
        for at in range(0, len(base), step):
            self._add(keys[at : at + step], base[at : at + step], None if allowed is None else allowed[:, at : at + step])

    def _add(self, keys, base, allowed) -> None:
        if not len(base) or not self.k or not len(self.q):
            return
        with np.errstate(over="ignore", invalid="ignore"):
            d = _fast(self.q, base, self.metric)
            top = (base * base).sum(axis=1).max()
            plain = np.isfinite(top + (self.q * self.q).sum(axis=1).max()) and top < 1e300
        if d.shape[1] <= self.k:
            near = np.ones(d.shape, bool)
        elif plain:
            # what may be off by rounding is looked at exactly
            off = _error(self.q, np.sqrt([[top]]) * np.eye(1, base.shape[1]), self.metric)
            if allowed is not None:
                d[~allowed] = np.inf
            near = d <= np.partition(d, self.k - 1, axis=1)[:, self.k - 1 : self.k] + 2 * off
        else:
            with np.errstate(over="ignore", invalid="ignore"):
                off = _error(self.q, base, self.metric)
                low, high = d - off, d + off
            low[~np.isfinite(low)], high[~np.isfinite(high)] = -np.inf, np.inf
            if allowed is not None:
                low[~allowed] = high[~allowed] = np.inf
            near = low <= np.partition(high, self.k - 1, axis=1)[:, self.k - 1 : self.k]
        if allowed is not None:
            near &= allowed
        row, col = np.nonzero(near)
        dist = _pairs(self.q, base, row, col, self.metric)
        self.merge(row, keys[col], dist)

    def merge(self, row: np.ndarray, keys: np.ndarray, dist: np.ndarray) -> None:
        """Takes in pairs whose distances are known."""
        self.keys = keys if self.keys is None else np.concatenate((self.keys, keys))
        self.row, self.dist = np.concatenate((self.row, row)), np.concatenate((self.dist, dist))
        self.cut()

    def cut(self) -> None:
        if self.keys is None:
            return
        order = np.lexsort((self.keys, self.dist, self.row))
        row = self.row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        order = order[rank < self.k]
        self.row, self.dist, self.keys = self.row[order], self.dist[order], self.keys[order]


def keys_of(column: pa.Array) -> np.ndarray:
    """Keys as an array that sorts as Spark does."""
    values = column.to_numpy(zero_copy_only=False)
    return values if values.dtype.kind in "iuf" else np.array([v.encode() if isinstance(v, str) else v for v in values], object)


def key_array(keys: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array([k.decode() if isinstance(k, bytes) else k for k in keys] if keys.dtype == object else keys, kind)


def query_blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, matrix) of the queries, at most QUERY_BYTES at a time."""
    q = queries.select("qid", F.col("q").cast("array<double>").alias("q")).where(F.col("q").isNotNull())
    width = q.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    if not width[0]:
        return
    blocks = -(-width[0] * max(1, width[1]) * 8 // QUERY_BYTES)
    for k in range(blocks):
        rows = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k)).toArrow()
        if rows.num_rows:
            yield rows.column("qid").to_pylist(), matrix(rows.column("q"), width[1])


def best(rows: DataFrame, k: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest rows (qid, key, distance, ...) of each query, ranked; Spark cuts each partition to k before it shuffles."""
    w = Window.partitionBy("qid").orderBy("distance", "key")
    ranked = rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
    return ranked.select("qid", "rank", "key", "distance", *keep)


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "l2_sq", where: Column | None = None, tombstones: DataFrame | None = None) -> DataFrame:
    """The k nearest rows of base (key, vector) for each row of queries (qid, q).

    where filters base rows before the search and tombstones (key) are left out, so neither costs results. Null vectors
    are passed over. k over the number of rows gives all, those at infinite distances and those whose distance isn't a number
    last; an empty base gives none. Metrics registered by the user are
    evaluated as column expressions.
    """
    metric = V.metric_name(metric)
    if k <= 0:
        base = base.limit(0)
    if where is not None:
        base = base.where(where)
    if tombstones is not None:
        base = base.join(tombstones.select("key").distinct(), "key", "left_anti")
    kind = base.schema["key"].dataType.simpleString()
    qkind = queries.schema["qid"].dataType.simpleString()
    base = base.select("key", F.col("vector").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull())
    spark, found = base.sparkSession, None
    for ids, q in query_blocks(queries):
        if metric not in ("l2_sq", "cosine", "inner_product", "euclidean"):
            rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, q)], f"qid {qkind}, q array<double>")
            part = F.broadcast(rows).join(base, F.lit(True)).select("qid", "key", V.distance("q", "vector", metric).alias("distance"))
        else:
            sent = spark.sparkContext.broadcast((ids, q))

            def scan(batches, sent=sent):
                qids, q = sent.value
                top, kinds = TopK(q, k, metric if metric != "euclidean" else "l2_sq"), None
                for b in batches:
                    kinds = b.schema.field(0).type
                    keys = keys_of(b.column(0))
                    top.add(keys, matrix(b.column(1), q.shape[1]))
                if top.keys is not None:
                    names = np.empty(len(qids), object)
                    names[:] = qids
                    dist = np.sqrt(top.dist) if metric == "euclidean" else top.dist
                    yield pa.RecordBatch.from_arrays([pa.array(names[top.row].tolist(), None if len(top.row) else pa.int64()), key_array(top.keys, kinds), pa.array(dist)], names=["qid", "key", "distance"])

            part = base.mapInArrow(scan, f"qid {qkind}, key {kind}, distance double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], f"qid {qkind}, rank long, key {kind}, distance double")
    return best(found, k)


def within(queries: DataFrame, base: DataFrame, radius: float, metric: str = "l2_sq") -> DataFrame:
    """All rows of base within radius of each query: qid, key, distance."""
    metric = V.metric_name(metric)
    kind, qkind = (d.schema[c].dataType.simpleString() for d, c in ((base, "key"), (queries, "qid")))
    base = base.select("key", F.col("vector").cast("array<double>").alias("vector")).where(F.col("vector").isNotNull())
    spark, found = base.sparkSession, None
    for ids, q in query_blocks(queries):
        sent = spark.sparkContext.broadcast((ids, q))

        def scan(batches, sent=sent):
            qids, q = sent.value
            for b in batches:
                v, keys = matrix(b.column(1), q.shape[1]), keys_of(b.column(0))
                for at in range(0, len(v), step := max(1, CELL_BYTES // (8 * len(q)))):
                    part = v[at : at + step]
                    with np.errstate(over="ignore", invalid="ignore"):
                        low = _fast(q, part, metric) - _error(q, part, "l2_sq" if metric == "euclidean" else metric)
                    row, col = np.nonzero(~(low > (radius * radius if metric == "euclidean" else radius)))
                    d = _pairs(q, part, row, col, metric)
                    near = d <= radius
                    yield pa.RecordBatch.from_arrays([pa.array([qids[r] for r in row[near]], pa.int64() if not near.any() else None), key_array(keys[at + col[near]], b.schema.field(0).type), pa.array(d[near])], names=["qid", "key", "distance"])

        part = base.mapInArrow(scan, f"qid {qkind}, key {kind}, distance double")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], f"qid {qkind}, key {kind}, distance double")


def knn_expr(queries: DataFrame, base: DataFrame, k: int, metric: str | Callable = "l2_sq", limit: int = 4096) -> DataFrame:
    """knn by column expressions, also for struct vectors of 8 bits: what `knn` is tested against. At most `limit` queries,
    which are broadcast."""
    n = queries.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"at most {limit} queries")
    fn = metric if callable(metric) else V.METRICS[V.metric_name(metric)]
    rows = F.broadcast(queries.select("qid", "q")).join(base.select("key", "vector"), F.lit(True))
    return best(rows.select("qid", "key", fn(F.col("q"), F.col("vector")).alias("distance")), k)


def ground_truth(queries: DataFrame, base: DataFrame, k: int, metric: str = "euclidean", normalise: bool = False, skip_self: bool = False) -> DataFrame:
    """Exact neighbours as arrays: qid, keys array, distances array. A query that is in the base finds itself, unless
    skip_self leaves out rows whose key equals the qid."""
    if normalise:
        queries, base = queries.withColumn("q", V.normalize("q")), base.withColumn("vector", V.normalize("vector"))
    found = knn(queries, base, k + skip_self, metric)
    if skip_self:
        found = best(found.where(F.col("qid").cast("string") != F.col("key").cast("string")).select("qid", "key", "distance"), k)
    rows = F.sort_array(F.collect_list(F.struct("rank", "key", "distance")))
    return found.groupBy("qid").agg(rows.alias("_r")).select("qid", F.transform("_r", lambda r: r["key"]).alias("keys"), F.transform("_r", lambda r: r["distance"]).alias("distances"))


def recall(expected: DataFrame, got: DataFrame) -> DataFrame:
    """One row: matched, total, recall (percent, over all queries together) of result rows (qid, key)."""
    e = expected.select("qid", "key").distinct()
    g = got.select("qid", "key").distinct().withColumn("_hit", F.lit(1))
    both = e.join(g, ["qid", "key"], "left")
    return both.agg(F.sum(F.coalesce("_hit", F.lit(0))).cast("long").alias("matched"), F.count(F.lit(1)).alias("total")).withColumn("recall", F.when(F.col("total") > 0, F.lit(100.0) * F.col("matched") / F.col("total")))


def sample(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, each set equally likely; reruns on the same rows agree."""
    return df.withColumn("_r", F.xxhash64(F.lit(seed), *df.columns)).orderBy("_r", *[c for c in df.columns if "map" not in df.schema[c].dataType.simpleString()]).limit(n).drop("_r")
