"""VectorTable: keyed vectors in a folder of Parquet tables, with a change log, indexes, search and maintenance.

Folder: config.json; base/<name> (key, vector), the compacted rows of a generation; log/b<number>-<name> (batch, seq, op, key,
vector), a batch of changes, which counts once it is whole; numbers/<number>, taken by whoever writes that batch; index/<name>,
a cell index or a neighbour graph over a generation's rows; codes/<name>, their compressed form; codebook/ once product
quantization is trained. current/<n> names the parts of generation n and the batches that it has taken in. It is created
last, so readers never see half of one. The generation before the current one stays for queries that still read it.

Writers never wait for each other: batches are ordered by their numbers, and a compaction takes in the batches that were whole
when it began; all others, also those that come in meanwhile, stay changes to the new generation.
"""

from __future__ import annotations

import dataclasses
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import InvalidConfig, TableExists, TableMissing
from ..functions import vectors as V
from ..operators import graph, mutate
from ..operators.clusters import IvfIndex
from ..operators.compress import ProductQuantizer, Truncation, compressed_search
from ..operators.knn import best, knn
from ..sources.scratch import kept


_ROW = "key string, vector array<float>"

#: Of an index's tables.
_SCHEMAS = {"nodes": f"id long, {_ROW}", "edges": "src long, dst long"}


@dataclasses.dataclass
class Config:
    """Settings of a table. The numbers are fixed values that tables elsewhere rely on."""

    dim: int = 0
    metric: str = "l2_sq"
    dtype: str = "f32"
    beam_width: int = 4
    max_edges: int = 64
    max_add_edges: int = 64
    distance_threshold: float = 1.1
    query_search_list_cap: int = 128
    update_search_list_cap: int = 128
    compaction_threshold_deletes: int = 1_000_000
    compression_mode: str = "pq"
    compression_threshold: int = 10_000_000
    pq_sample_size: int = 10_000
    pq_subspaces: int = 64
    trunc_dims: int = 64

    def __post_init__(self):
        self.metric = V.metric_name(self.metric)
        if self.dim <= 0:
            raise InvalidConfig("dim must be set")
        if self.dtype not in V.CASTS:
            raise InvalidConfig(f"dtype is one of {', '.join(V.CASTS)}")
        if self.compression_mode not in ("pq", "trunc"):
            raise InvalidConfig("compression_mode is pq or trunc")
        for name in ("beam_width", "max_edges", "max_add_edges", "query_search_list_cap", "update_search_list_cap", "compaction_threshold_deletes", "pq_sample_size", "pq_subspaces", "trunc_dims"):
            if getattr(self, name) < 1:
                raise InvalidConfig(f"{name} is at least 1")
        if self.distance_threshold < 1:
            raise InvalidConfig("distance_threshold is at least 1")

    @classmethod
    def of(cls, values: dict) -> Config:
        """From a dict that may leave out settings; unknown ones are refused."""
        names = {f.name for f in dataclasses.fields(cls)}
        if unknown := set(values) - names:
            raise InvalidConfig(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**values)


class _Files:
    """Small files and folders by Spark's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def fs(self):
        return self.path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, *parts: str) -> bool:
        return self.fs().exists(self.path(*parts))

    def names(self, *parts: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs().listStatus(self.path(*parts))] if self.exists(*parts) else []

    def drop(self, *parts: str) -> None:
        self.fs().delete(self.path(*parts), True)

    def write(self, text: str, *parts: str) -> None:
        """A new file; an error if it is there."""
        out = self.fs().create(self.path(*parts), False)
        out.write(bytearray(text.encode()))
        out.close()

    def publish(self, text: str, *parts: str) -> bool:
        """A new file that appears whole; False if it is there already."""
        hidden = (*parts[:-1], f".{parts[-1]}-{uuid.uuid4().hex}")
        self.write(text, *hidden)
        done = not self.exists(*parts) and self.fs().rename(self.path(*hidden), self.path(*parts))
        if not done:
            self.drop(*hidden)
        return done

    def read(self, *parts: str) -> str:
        file = self.fs().open(self.path(*parts))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()


class VectorTable:
    def __init__(self, spark: SparkSession, path: str | None, config: Config, rows: DataFrame | None = None):
        self.spark, self.path, self.config = spark, path, config
        self._files = _Files(spark, path) if path else None
        self._memory = rows

    # --- opening

    @classmethod
    def create(cls, spark: SparkSession, path: str, config: Config | dict) -> VectorTable:
        table = cls(spark, path, Config.of(config) if isinstance(config, dict) else config)
        if table._files.exists("config.json"):
            raise TableExists(path)
        table._files.write(json.dumps(dataclasses.asdict(table.config)), "config.json")
        table._files.publish(json.dumps({"base": None, "folded": []}), "current", "0")
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorTable:
        files = _Files(spark, path)
        if not files.exists("config.json"):
            raise TableMissing(path)
        return cls(spark, path, Config.of(json.loads(files.read("config.json"))))

    @classmethod
    def from_df(cls, rows: DataFrame, config: Config | dict) -> VectorTable:
        """A table of rows (key, vector) that isn't written anywhere."""
        table = cls(rows.sparkSession, None, Config.of(config) if isinstance(config, dict) else config)
        table._memory = table._clean(rows)
        return table

    # --- rows

    @property
    def generation(self) -> int:
        return max(int(n) for n in self._files.names("current") if n.isdigit())

    def _current(self) -> dict:
        n = self.generation
        return {"generation": n, **json.loads(self._files.read("current", str(n)))}

    def _read(self, *parts: str) -> DataFrame:
        known = self.spark.read.schema(_SCHEMAS[parts[-1]]) if parts[-1] in _SCHEMAS else self.spark.read
        return known.parquet("/".join((self.path, *parts)))

    def _batches(self, state: dict) -> list[str]:
        """Folders of the whole batches that a generation hasn't taken in."""
        found = [b for b in self._files.names("log") if b not in state["folded"]]
        return sorted(b for b in found if self._files.exists("log", b, "_SUCCESS"))

    def _base(self, state: dict) -> DataFrame:
        if state["base"] is None:
            return self.spark.createDataFrame([], _ROW)
        return self.spark.read.schema(_ROW).parquet(f"{self.path}/base/{state['base']}")

    def _changes(self, batches: list[str]) -> DataFrame | None:
        """The batches' rows (seq, op, key, vector); seq orders them by batch first."""
        if not batches:
            return None
        rows = self.spark.read.schema(f"batch long, seq long, op string, {_ROW}").parquet(*(f"{self.path}/log/{b}" for b in batches))
        return rows.select(F.struct("batch", "seq").alias("seq"), "op", "key", "vector")

    def rows(self) -> DataFrame:
        """Live rows (key, vector)."""
        if self._files is None:
            return self._memory
        state = self._current()
        changes = self._changes(self._batches(state))
        return self._base(state) if changes is None else mutate.upsert(self._base(state), changes)

    def keys(self) -> DataFrame:
        """Keys of the live rows."""
        return self.rows().select("key")

    def is_deleted(self, key: str) -> bool:
        """Whether the last change of the key is a deletion that no compaction has taken in yet."""
        changes = None if self._files is None else self._changes(self._batches(self._current()))
        return changes is not None and mutate.latest(changes.where(F.col("key") == key)).where("op = 'delete'").limit(1).count() > 0

    def get(self, keys: DataFrame) -> DataFrame:
        """(key, vector) of each row of keys, null for those that aren't there."""
        return keys.select(F.col("key").cast("string").alias("key")).join(self.rows(), "key", "left")

    def count(self) -> int:
        return self.rows().count()

    def _clean(self, rows: DataFrame, *more: str) -> DataFrame:
        """key and vector with odd values made finite, rounded to the table's type, and of its length."""
        v = V.CASTS[self.config.dtype](V.nan_to_num("vector", self.config.dtype)).cast("array<float>")
        size = F.size("vector")
        v = F.when(size == self.config.dim, v).otherwise(F.raise_error(F.concat(F.lit(f"vectors have {self.config.dim} elements, not "), size.cast("string"))).cast("array<float>"))
        return rows.select(F.col("key").cast("string").alias("key"), v.alias("vector"), *more).where(F.col("key").isNotNull() & F.col("vector").isNotNull())

    # --- changes

    def _log(self, changes: DataFrame) -> None:
        """Writes (op, key, vector) as one batch; of a key that comes twice in it either may win, unless seq is given."""
        number = max((int(n) for n in self._files.names("numbers") if n.isdigit()), default=-1) + 1
        while not self._files.publish("", "numbers", f"{number:012}"):
            number += 1
        seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
        rows = changes.select(F.lit(number).cast("long").alias("batch"), seq.cast("long").alias("seq"), "op", "key", "vector")
        rows.write.parquet(f"{self.path}/log/b{number:012}-{uuid.uuid4().hex}")

    def insert(self, rows: DataFrame) -> None:
        """Upserts rows (key, vector, and seq where keys repeat)."""
        d = self._seq(rows)
        if self._files is None:
            self._memory = mutate.upsert(self._memory, d.withColumn("op", F.lit("insert")))
        else:
            self._log(d.withColumn("op", F.lit("insert")))

    def _seq(self, rows: DataFrame) -> DataFrame:
        """Cleaned rows with seq; of equal keys without one the greatest vector counts last, so that reruns agree."""
        if "seq" in rows.columns:
            return self._clean(rows, "seq")
        return self._clean(rows).groupBy("key").agg(F.max("vector").alias("vector")).withColumn("seq", F.lit(0).cast("long"))

    def delete(self, keys: DataFrame) -> None:
        """Deletes keys; those that aren't there are passed over."""
        d = keys.select(F.lit(0).cast("long").alias("seq"), F.lit("delete").alias("op"), F.col("key").cast("string").alias("key"), F.lit(None).cast("array<float>").alias("vector"))
        if self._files is None:
            self._memory = mutate.upsert(self._memory, d)
        else:
            self._log(d)
            if self.deleted() >= self.config.compaction_threshold_deletes:
                self.compact()

    def deleted(self) -> int:
        """Keys whose last change is a deletion that no compaction has taken in yet."""
        changes = None if self._files is None else self._changes(self._batches(self._current()))
        return 0 if changes is None else mutate.latest(changes).where("op = 'delete'").count()

    def compact(self) -> dict | None:
        """Takes the changes that are whole now into a new generation: base rows, index and codes. Changes that come in
        meanwhile stay changes. A neighbour graph is mended, not built anew: nodes next to deleted ones get those ones'
        neighbours, new rows are linked with what a search finds. Returns counts (rows, deleted, changed, touched nodes of the
        graph), or None if there was nothing to do or another compaction came first.
        """
        state = self._current()
        batches = self._batches(state)
        if not batches:
            return None
        last = kept(mutate.latest(self._changes(batches)))
        name = uuid.uuid4().hex
        mutate.replace(self._base(state), last).write.parquet(f"{self.path}/base/{name}")
        rows = self._base({"base": name})
        # what the last generation took in may still lie there, and must not count again
        new = {"base": name, "folded": batches + state["folded"], "rows": rows.count()}
        deleted, changed = last.agg(F.count_if(F.col("op") == "delete"), F.count_if(F.col("op") != "delete")).first()
        found = {"rows": new["rows"], "deleted": deleted, "changed": changed, "touched": 0}
        if state.get("index"):
            if state["index"]["kind"] == "cells":
                new["index"] = self._cells(rows, state["index"]["cells"])
            else:
                new["index"], found["touched"] = self._mended(state["index"]["name"], last, changed)
        if state.get("codes") or new["rows"] > self.config.compression_threshold:
            new["codes"] = self._encoded(rows)
        if not self._files.publish(json.dumps(new), "current", str(state["generation"] + 1)):
            for kind, part in (("base", name), ("index", (new.get("index") or {}).get("name")), ("codes", new.get("codes"))):
                if part:
                    self._files.drop(kind, part)
            return None
        self._forget(state["generation"])
        return found

    def _forget(self, old: int) -> None:
        """Deletes what only generations before `old` use, and the batches that `old` had taken in: neither it nor its
        successor reads them."""
        states = {int(n): json.loads(self._files.read("current", n)) for n in self._files.names("current") if n.isdigit()}
        live = [s for n, s in states.items() if n >= old]
        for n in (n for n in states if n < old):
            s = states[n]
            for kind, part in (("base", s["base"]), ("index", (s.get("index") or {}).get("name")), ("codes", s.get("codes"))):
                if part and all(part != x for t in live for x in (t["base"], (t.get("index") or {}).get("name"), t.get("codes"))):
                    self._files.drop(kind, part)
            self._files.drop("current", str(n))
        for b in states[old]["folded"]:
            self._files.drop("log", b)

    # --- indexes

    def build_index(self, kind: str = "graph", cells: int = 64) -> None:
        """Gives the table an index of its live rows, which query then uses: "graph", a neighbour graph with the settings'
        max_edges and distance_threshold, or "cells", rows by their nearest of `cells` centroids."""
        self.compact()
        state = self._current()
        rows = self._base(state)
        if kind == "cells":
            index = self._cells(kept(rows), cells)
        elif kind == "graph":
            name, c = uuid.uuid4().hex, self.config
            nodes = mutate.with_ids(rows, few=self._few(state.get("rows"))).select("id", "key", "vector")
            nodes.write.parquet(f"{self.path}/index/{name}/nodes")
            nodes = self._read("index", name, "nodes")
            edges, entry = graph.built(nodes, c.max_edges, c.distance_threshold, c.max_edges, c.metric)
            edges.select("src", "dst").write.parquet(f"{self.path}/index/{name}/edges")
            index = {"kind": kind, "name": name, "entry": entry}
        else:
            raise InvalidConfig("an index is graph or cells")
        self._publish(state, index=index)

    def _publish(self, state: dict, **parts) -> None:
        new = {k: v for k, v in state.items() if k != "generation"} | parts
        if not self._files.publish(json.dumps(new), "current", str(state["generation"] + 1)):
            raise TableExists("another generation came first; build again")
        self._forget(state["generation"])

    def _cells(self, rows: DataFrame, cells: int) -> dict:
        name = uuid.uuid4().hex
        index = IvfIndex.build(rows, cells, self.config.metric, path=f"{self.path}/index/{name}/rows")
        index.save(self.spark, f"{self.path}/index/{name}/centroids")
        return {"kind": "cells", "name": name, "cells": cells}

    def _few(self, rows: int | None) -> bool:
        """Whether so many rows are few enough for one task, as for a graph in memory."""
        return rows is not None and rows <= graph.WHOLE_ROWS and rows * self.config.dim * 8 <= graph.WHOLE_BYTES

    def _mended(self, name: str, last: DataFrame, changed: int) -> tuple[dict, int]:
        """A graph after changes, `changed` of them new rows: (its entry in the generation, nodes whose edges changed)."""
        c, new = self.config, uuid.uuid4().hex
        nodes, edges = self._read("index", name, "nodes"), self._read("index", name, "edges")
        shift = nodes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
        fresh = mutate.with_ids(last.where("op != 'delete'").select("key", "vector"), shift, self._few(changed)).select("id", "key", "vector")
        live = nodes.join(last.select("key"), "key", "left_anti")
        live.select("id", "key", "vector").unionByName(fresh).write.parquet(f"{self.path}/index/{new}/nodes")
        done = graph.mended(edges, self._read("index", new, "nodes"), shift, c.distance_threshold, c.max_edges, c.max_add_edges, c.metric, c.update_search_list_cap, c.beam_width)
        if done is not None:
            after, entry, touched = done
            after.select("src", "dst").write.parquet(f"{self.path}/index/{new}/edges")
            return {"kind": "graph", "name": new, "entry": entry}, touched
        gone, fresh = kept(nodes.join(last.select("key"), "key", "left_semi").select("id")), kept(fresh)
        before = kept(graph.compact_edges(edges, gone, nodes, c.distance_threshold, c.max_edges, c.metric))
        nodes = self._read("index", new, "nodes")
        after = graph.extend(before, nodes, fresh, c.distance_threshold, c.max_edges, c.max_add_edges, c.metric, c.update_search_list_cap, c.beam_width)
        entry = graph.medoid(nodes, c.metric) if nodes.limit(1).count() else None
        after = after.select("src", F.row_number().over(Window.partitionBy("src").orderBy("dst")).cast("long").alias("pos"), "dst")
        after = graph.connected(after, nodes, entry, c.max_edges + c.max_add_edges, c.metric)  # deletions and prunings may cut nodes off
        after.select("src", "dst").write.parquet(f"{self.path}/index/{new}/edges")
        after = self._read("index", new, "edges")
        touched = after.exceptAll(edges).select("src").union(edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").exceptAll(after).select("src")).distinct().count()
        return {"kind": "graph", "name": new, "entry": entry}, touched

    def entry_key(self) -> str | None:
        """The key of the node where searches of the graph begin; None without a graph or rows."""
        index = self._current().get("index") or {}
        found = self._read("index", index["name"], "nodes").where(F.col("id") == index["entry"]).select("key").first() if index.get("entry") is not None else None
        return found.key if found else None

    # --- search

    def query(self, queries: DataFrame, k: int, where: Column | None = None, exact: bool = False, nprobe: int = 8) -> DataFrame:
        """The k nearest rows of each query (qid, q): qid, rank, key, distance. An empty table gives none.

        Exact, by a scan, for a table without an index or if `exact`. With one, rows of the index are found through it (a
        graph by beam_width and query_search_list_cap, cells by nprobe), which may miss some; changes since are compared
        one and all. where filters rows by key and vector before they can be results; deleted rows never are.
        """
        q = queries.withColumn("q", V.CASTS[self.config.dtype](V.nan_to_num("q", self.config.dtype)))
        state = self._current() if self._files is not None else {}
        index = state.get("index")
        if exact or not index:
            return knn(q, self.rows(), k, self.config.metric, where)
        c, changes, found = self.config, self._changes(self._batches(state)), None
        q = kept(q.select("qid", "q"))
        last = None if changes is None else kept(mutate.latest(changes))
        if index["kind"] == "cells":
            cells = IvfIndex.load(self.spark, f"{self.path}/index/{index['name']}/rows", f"{self.path}/index/{index['name']}/centroids", c.metric)
            if last is not None:
                cells.cells = cells.cells.join(last.select("key"), "key", "left_anti")
            found = cells.search(q, k, nprobe, where)
        elif index["entry"] is not None:
            nodes, edges = self._read("index", index["name"], "nodes"), self._read("index", index["name"], "edges")
            allowed = nodes if where is None else nodes.where(where)
            if last is not None:
                allowed = allowed.join(last.select("key"), "key", "left_anti")
            allowed = None if where is None and last is None else kept(allowed.select("id"))
            found = graph.beam_search(q, edges, nodes, k, index["entry"], max(k, c.query_search_list_cap), c.beam_width, c.metric, allowed=allowed)
            found = found.withColumnRenamed("key", "id").join(nodes.select("id", "key"), "id").select("qid", "rank", "key", "distance")
        if last is not None:
            fresh = knn(q, last.where("op != 'delete'").select("key", "vector"), k, c.metric, where)
            found = fresh if found is None else best(found.unionByName(fresh).drop("rank"), k)
        return knn(q, self.rows(), k, c.metric, where) if found is None else found

    def insert_qi8(self, rows: DataFrame) -> None:
        """Upserts rows whose vectors are 8-bit structs; they are kept as the table's type."""
        self.insert(rows.withColumn("vector", V.qi8_dequantize("vector")))

    def query_qi8(self, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
        return self.query(queries.withColumn("q", V.qi8_dequantize("q")), k, where)

    def compressor(self):
        """The compression that the settings name: trained and stored on first use if it is product quantization."""
        if self.config.compression_mode == "trunc":
            return Truncation(self.config.trunc_dims)
        if self._files is not None and self._files.exists("codebook"):
            return ProductQuantizer.from_table(self.spark.read.parquet(f"{self.path}/codebook"))
        pq = ProductQuantizer.train(self.rows(), self.config.pq_subspaces, self.config.pq_sample_size)
        if self._files is not None:
            pq.table(self.spark).write.parquet(f"{self.path}/codebook")
        return pq

    def _encoded(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        self.compressor().encode(rows).write.parquet(f"{self.path}/codes/{name}")
        return name

    def compress(self) -> None:
        """Stores the compressed form of the table's rows; compactions do so by themselves over compression_threshold rows."""
        self.compact()
        state = self._current()
        self._publish(state, codes=self._encoded(self._base(state)))

    def compressed(self) -> bool:
        """Whether search goes by compressed vectors: they are stored, or there are over compression_threshold rows, those that
        changes have added counted as well (without looking for the rows that they replace)."""
        if self._files is None:
            return self.count() > self.config.compression_threshold
        state = self._current()
        if state.get("codes"):
            return True
        changes = self._changes(self._batches(state))
        return state.get("rows", 0) + (0 if changes is None else changes.where("op != 'delete'").count()) > self.config.compression_threshold

    def query_compressed(self, queries: DataFrame, k: int, widen: int = 4) -> DataFrame:
        """query by compressed vectors, then exactly among the widen * k best. Stored codes are read; only rows changed since
        are encoded."""
        c = self.compressor()
        state = self._current() if self._files is not None else {}
        if not state.get("codes"):
            rows = c.encode(self.rows())
        else:
            rows = self._read("codes", state["codes"])
            changes = self._changes(self._batches(state))
            if changes is not None:
                last = kept(mutate.latest(changes))
                rows = rows.join(last.select("key"), "key", "left_anti").unionByName(c.encode(last.where("op != 'delete'").select("key", "vector")))
        return compressed_search(c, queries, rows, k, self.config.metric, widen)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query, by compressed vectors once they are stored or the table has over compression_threshold rows."""
        return self.query_compressed(queries, k) if self.compressed() else self.query(queries, k)

    def ivf(self, n_cells: int = 64, path: str | None = None) -> IvfIndex:
        return IvfIndex.build(self.rows(), n_cells, self.config.metric, path=path)
