"""Substring dedup by a log-structured fingerprint index.

Windows of 13 words are fingerprinted. The index is a table of immutable runs, one a batch, each the sorted fingerprints
of the windows that were new then. Runs are bucketed by fingerprint group, so a new batch is shuffled once, to the
groups, and merge-joined there with all runs as they lie. A match on the 40-bit key is verified by a 24-bit check and a
32-bit proof, both from a hash of another family; with the group's own bits a window has 102 bits and more. Words are not
compared again: two different windows pass as one with a chance of about 10^-15 over 0.5 GB of text and 10^-9 over 100 TB.
What is new becomes the next run; when enough runs of a level have gathered they are compacted into one of the next level.
Which runs count is written beside them once they are whole, so an index can be opened again in another session, and
what a crash has left half done is dropped.

Within a task, a window's documents are reduced to the smallest before the shuffle and the others marked at once, so a
passage that a third of all documents share sends one fingerprint a task, not one a document.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _trim, drop_path, dropping_shuffles, file_names, move_path, read_text, released, scratch_path, text_bytes, write_text

WINDOW = 13
#: Windows that a task gathers before it sends them, bytes of text a group should stand for, runs of a level that are compacted.
FLUSH, GROUP_BYTES, FAN_IN = 1 << 19, 16 << 20, 4
#: Fingerprints in a row of a run.
PART = 1 << 15
#: Least number of batches, one more than are compacted, and most bytes of text in one.
BATCHES, BATCH_BYTES = 5, 2 << 40
_KEY_BITS, _CHECK_BITS = 40, 24
_P = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_LEAST = -(1 << 63)


class WordHashes:
    """Two 64-bit hashes of each word, remembered up to `cache` words."""

    def __init__(self, cache: int = 100_000):
        self.cache = cache
        self._clear()

    def _clear(self) -> None:
        # numbers come from a counter: a method of the table itself would be a cycle, by which old tables, words and all, stay
        # until a full garbage collection, which rarely comes where nearly all is arrays
        self.ids: defaultdict = defaultdict(itertools.count().__next__)
        self.values = np.zeros((0, 2), np.uint64)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.ids) > self.cache:
            self._clear()
        at = np.array(list(map(self.ids.__getitem__, words)), np.int64)
        if len(self.ids) > len(self.values):
            full = xxhash.xxh3_128_digest
            new = list(self.ids)[len(self.values) :] if not len(self.values) else [w for w, _ in zip(reversed(self.ids), range(len(self.ids) - len(self.values)))][::-1]
            self.values = np.concatenate((self.values, np.frombuffer(b"".join(map(full, new)), "<u8").reshape(-1, 2)))
        return self.values[at, 0], self.values[at, 1]


def _polynomial(a: np.ndarray, p: np.uint64, n: int) -> np.ndarray:
    """Hash of each run of n values: of 2^k values by doubling, then joined."""
    with np.errstate(over="ignore"):
        power, size, have, done = p, 1, a, None
        done_size = 0
        while True:
            if n & size:
                if done is None:
                    done, done_size = have, size
                else:  # the shorter, found first, follows the longer
                    m = len(a) - size - done_size + 1
                    done = have[:m] * _power(p, done_size) + done[size : size + m]
                    done_size += size
            if size * 2 > n:
                break
            have = have[:-size] * power + have[size:]
            power, size = power * power, size * 2
        h = done
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))


def _power(p: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(p), n, 1 << 64))


def fingerprints(words: list[bytes], hashes: WordHashes, window: int, group_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, key and check as one uint64, proof as uint32) of every window of the words."""
    if len(words) < window:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    a, b = (_polynomial(x, p, window) for x, p in zip(hashes(words), _P))
    group = (a >> np.uint64(64 - group_bits)).astype(np.int32) if group_bits else np.zeros(len(a), np.int32)
    key = (a >> np.uint64(64 - group_bits - _KEY_BITS)) & np.uint64((1 << _KEY_BITS) - 1)
    return group, (key << np.uint64(_CHECK_BITS)) | (b >> np.uint64(64 - _CHECK_BITS)), b.astype(np.uint32)


def pack(prints: np.ndarray, proofs: np.ndarray) -> bytes:
    """Sorted fingerprints: the first key in 8 bytes, differences of keys in 4 (8 where one needs them), checks in 3, proofs in 4."""
    key = prints >> np.uint64(_CHECK_BITS)
    step = np.diff(key, prepend=key[:1])
    width = 4 if not len(step) or int(step.max()) < 1 << 32 else 8
    check = (prints & np.uint64((1 << _CHECK_BITS) - 1)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    return bytes([width]) + (key[:1].astype("<u8").tobytes() or bytes(8)) + step.astype(f"<u{width}").tobytes() + check.tobytes() + proofs.astype("<u4").tobytes()


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    width, at = blob[0], 9
    n = (len(blob) - at) // (width + 7)
    key = np.cumsum(np.frombuffer(blob, f"<u{width}", n, at), dtype=np.uint64) + np.frombuffer(blob, "<u8", 1, 1)
    check = np.zeros((n, 4), np.uint8)
    check[:, :3] = np.frombuffer(blob, np.uint8, 3 * n, at + width * n).reshape(-1, 3)
    return (key << np.uint64(_CHECK_BITS)) | check.view("<u4").ravel(), np.frombuffer(blob, "<u4", n, at + (width + 3) * n)


def _rows(group: int, prints: np.ndarray, proofs: np.ndarray) -> list[tuple]:
    """A group's run as rows of _OUT, PART fingerprints in each."""
    return [(_ENTRY, group, None, pack(prints[at : at + PART], proofs[at : at + PART])) for at in range(0, len(prints), PART)]


def _sorted(prints: np.ndarray, proofs: np.ndarray) -> np.ndarray:
    """An order by prints; by proofs too should any equal prints have different ones."""
    order = np.argsort(prints, kind="stable")
    p, q = prints[order], proofs[order]
    return np.lexsort((proofs, prints)) if ((p[1:] == p[:-1]) & (q[1:] != q[:-1])).any() else order


def _firsts(prints: np.ndarray, proofs: np.ndarray) -> np.ndarray:
    """Where each distinct fingerprint begins in a sorted series."""
    return np.flatnonzero(np.concatenate(([len(prints) > 0], (prints[1:] != prints[:-1]) | (proofs[1:] != proofs[:-1]))))


def _among(prints: np.ndarray, proofs: np.ndarray, run: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which fingerprints a sorted run has: found by key and check, verified by proof."""
    have, proof = run
    if not len(have):
        return np.zeros(len(prints), bool)
    to = np.searchsorted(have, prints)
    found = np.zeros(len(prints), bool)
    left = np.arange(len(prints))
    while len(left):  # again only for equal keys and checks whose proof differs
        left = left[to[left] < len(have)]
        left = left[have[to[left]] == prints[left]]
        fine = proof[to[left]] == proofs[left]
        found[left[fine]] = True
        left = left[~fine]
        to[left] += 1
    return found


_ENTRY, _HIT = 0, 1
#: Rows of a batch on its way: kind, group; of entries packed prints and, at the same places, documents; of hits prints and one document.
_ROW = pa.schema([("kind", pa.int32()), ("grp", pa.int32()), ("prints", pa.binary()), ("docs", pa.binary())])
_OUT = pa.schema([("kind", pa.int32()), ("grp", pa.int32()), ("doc", pa.int64()), ("prints", pa.binary())])


def _sketched(batches, window: int, group_bits: int, flush: int):
    """Rows of _ROW for rows (doc long, text bytes)."""
    hashes = WordHashes()
    pending: list[tuple[np.ndarray, ...]] = []
    size = 0

    def send():
        nonlocal size
        group, prints, proofs, doc = (np.concatenate(x) for x in zip(*pending))
        pending.clear()
        size = 0
        order = _sorted(prints, proofs)
        order = order[np.argsort(group[order].astype(np.uint16) if group_bits <= 16 else group[order], kind="stable")]
        group, prints, proofs, doc = group[order], prints[order], proofs[order], doc[order]
        new_group = np.concatenate(([True], group[1:] != group[:-1]))
        first = np.union1d(_firsts(prints, proofs), np.flatnonzero(new_group))
        least = np.minimum.reduceat(doc, first)
        other = doc != np.repeat(least, np.diff(np.append(first, len(doc))))
        rows: list[tuple] = []
        prints_1, proofs_1, group_1 = prints[first], proofs[first], group[first]
        cut = np.concatenate(([0], np.flatnonzero(group_1[1:] != group_1[:-1]) + 1, [len(first)]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            rows.append((_ENTRY, int(group_1[a]), pack(prints_1[a:b], proofs_1[a:b]), _pack_docs(least[a:b])))
        # the others have a smaller document in this very task
        rows += [(_HIT, int(np.uint64(d & (1 << 64) - 1) % np.uint64(1 << group_bits)), p, np.array([d], "<i8").tobytes()) for d, p in _by_doc(doc[other], prints[other])]
        del group, prints, proofs, doc, order, new_group, first, least, other, prints_1, proofs_1, group_1  # not needed while rows are sent
        for at in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows[at : at + 4096]), _ROW)], schema=_ROW)

    for b in batches:
        ids, texts = np.asarray(b.column(0)), b.column(1)
        for n, t in enumerate(texts):
            words = t.as_py().split()
            group, prints, proofs = fingerprints(words, hashes, window, group_bits)
            if len(prints):
                pending.append((group, prints, proofs, np.full(len(prints), ids[n], np.int64)))
                size += len(prints)
                if size >= flush:
                    yield from send()
    if pending:
        yield from send()


def _pack_docs(docs: np.ndarray) -> bytes:
    """Document ids by a table of them and places in it."""
    table, at = np.unique(docs, return_inverse=True)
    width = 2 if len(table) <= 1 << 16 else 4
    return np.array([len(table)], "<i8").tobytes() + table.astype("<i8").tobytes() + at.astype(f"<u{width}").tobytes()


def _unpack_docs(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    table = np.frombuffer(blob, "<i8", n, 8)
    return table[np.frombuffer(blob, "<u2" if n <= 1 << 16 else "<u4", offset=8 + 8 * n)]


def _by_doc(doc: np.ndarray, prints: np.ndarray):
    """(document, keys and checks) of hits. Proofs aren't needed any more: a document's own windows are looked for."""
    if not len(doc):
        return
    order = np.argsort(doc, kind="stable")
    doc, prints = doc[order], prints[order]
    cut = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)]))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        yield int(doc[a]), prints[a:b].tobytes()


def _merged(group: int, new: pa.Table, runs: pa.Table | None) -> pa.Table:
    """Merge-joins a group's entries with its runs: rows of _OUT, the group's new run and the hits."""
    kinds = new.column("kind").to_pylist()
    prints, docs = new.column("prints").to_pylist(), new.column("docs").to_pylist()
    out: list[tuple] = [(_HIT, group, int(np.frombuffer(d, "<i8")[0]), p) for k, p, d in zip(kinds, prints, docs) if k == _HIT]
    blobs = [(*unpack(p), _unpack_docs(d)) for k, p, d in zip(kinds, prints, docs) if k == _ENTRY]
    if blobs:
        p, q, d = (np.concatenate(x) for x in zip(*blobs))
        order = _sorted(p, q)
        p, q, d = p[order], q[order], d[order]
        first = _firsts(p, q)
        least = np.minimum.reduceat(d, first)
        unique, proof, n = p[first], q[first], np.diff(np.append(first, len(p)))
        old = np.zeros(len(unique), bool)
        for blob in runs.column("prints") if runs is not None else ():
            run = unpack(blob.as_py())
            a, b = np.searchsorted(unique, run[0][:1])[0], np.searchsorted(unique, run[0][-1:], "right")[0]
            old[a:b] |= _among(unique[a:b], proof[a:b], run)
        hit = np.repeat(old, n) | (d != np.repeat(least, n))
        out += [(_HIT, group, doc, x) for doc, x in _by_doc(d[hit], p[hit])]
        if not old.all():
            out += _rows(group, unique[~old], proof[~old])
    return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), _OUT)] if out else [pa.array([], t.type) for t in _OUT], schema=_OUT)


def _freed(table: pa.Table) -> pa.Table:
    _trim()
    return table


class FingerprintIndex:
    """An index of window fingerprints that batches are deduplicated against and then added to.

    path: its folder; one that holds an index is opened, with its own group_bits, window and buckets. By default it is one
    in the cluster's shared folder, gone when the index is closed or the application ends. group_bits: binary logarithm of
    the number of groups. One session at a time may add to an index.
    """

    def __init__(self, spark: SparkSession, group_bits: int = 6, window: int = WINDOW, path: str | None = None, fan_in: int = FAN_IN, flush: int = FLUSH):
        self.spark, self.fan_in, self.flush = spark, fan_in, flush
        self.name, self.own = f"vecloom_runs_{uuid.uuid4().hex}", path is None
        self.path = path or scratch_path(spark, "runs")
        states = self._states()
        state = json.loads(read_text(spark, f"{self.path}/_runs/{states[-1]}")) if states else {}
        self.group_bits, self.window = state.get("group_bits", group_bits), state.get("window", window)
        self.buckets = state.get("buckets", min(1 << group_bits, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)))
        #: run number -> level
        self.runs: dict[int, int] = {int(n): level for n, level in state.get("runs", {}).items()}
        self.next, self.last = state.get("next", 0), None
        spark.sql(f"CREATE TABLE {self.name} (grp INT, doc BIGINT, prints BINARY, run INT, kind INT) USING parquet PARTITIONED BY (run, kind) CLUSTERED BY (grp) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        if states:
            spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")
            for n in {int(x.partition("=")[2]) for x in file_names(spark, self.path) if x.startswith("run=")} - set(self.runs):
                self._drop_run(n)

    def _states(self) -> list[str]:
        return sorted((x for x in file_names(self.spark, f"{self.path}/_runs") if x.isdigit()), key=int)

    def _save(self) -> None:
        """Writes which runs count; the file with the greatest number holds, and it appears whole."""
        states = self._states()
        folder = f"{self.path}/_runs"
        state = {"group_bits": self.group_bits, "window": self.window, "buckets": self.buckets, "runs": self.runs, "next": self.next}
        number = int(states[-1]) + 1 if states else 0
        write_text(self.spark, f"{folder}/.{number}", json.dumps(state))
        move_path(self.spark, f"{folder}/.{number}", f"{folder}/{number}")
        for x in states[:-1]:
            drop_path(self.spark, f"{folder}/{x}")

    def dedup(self, docs: DataFrame) -> DataFrame:
        """Deduplicates a batch against all earlier ones and itself, and adds it to the index.

        Every word covered by a window that an earlier batch has, or a document of this batch with a smaller doc_id, is
        removed; windows are judged on the batch as it came. Returns all rows: doc_id, n_words, n_removed, kept (the
        words that are left, joined by single spaces). Null text has no words. doc_id is an integer; null comes before
        all others; rows with equal ids don't remove from each other, but windows of one mark those of the other if some
        smaller document has them. Extra columns aren't read.
        """
        number = self.last = self.next
        self.next += 1
        window, bits, flush = self.window, self.group_bits, self.flush
        keyed = docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("_d"), text_bytes().alias("_x"))
        rows = keyed.select("_d", "_x").mapInArrow(released(lambda b: _sketched(b, window, bits, flush)), "kind int, grp int, prints binary, docs binary")
        shape = "kind int, grp int, doc long, prints binary"
        if self.runs:
            def both(key, new, runs):
                return _freed(_merged(key[0].as_py(), new, runs))

            old = self.spark.table(self.name).where(F.col("run").isin(*self.runs) & (F.col("kind") == _ENTRY)).select("grp", "prints")
            out = rows.groupBy("grp").cogroup(old.groupBy("grp")).applyInArrow(both, shape)
        else:
            def alone(key, new):
                return _freed(_merged(key[0].as_py(), new, None))

            out = rows.groupBy("grp").applyInArrow(alone, shape)
        self._append(out, number)
        self.runs[number] = 0
        self._save()
        hits = self.spark.table(self.name).where((F.col("run") == number) & (F.col("kind") == _HIT)).groupBy(F.col("doc").alias("_h")).agg(F.collect_list("prints").alias("_p"))
        joined = keyed.join(hits, keyed["_d"] == hits["_h"], "left").select("doc_id", "_x", "_p")
        kind = docs.schema["doc_id"].dataType.simpleString()

        def clean(batches):
            hashes = WordHashes()
            for b in (x.slice(at, 512) for x in batches for at in range(0, x.num_rows, 512)):
                total, removed, kept = [], [], []
                for t, p in zip(b.column(1), b.column(2)):
                    words = t.as_py().split()
                    total.append(len(words))
                    if p.is_valid:
                        bad = np.frombuffer(b"".join(p.as_py()), "<u8")
                        hit = np.isin(fingerprints(words, hashes, window, bits)[1], bad)
                        edge = np.zeros(len(words) + 1, np.int32)
                        edge[: len(hit)] += hit
                        edge[window : window + len(hit)] -= hit
                        gone = np.cumsum(edge[:-1]) > 0
                        removed.append(int(gone.sum()))
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    else:
                        removed.append(0)
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pc.cast(pa.array(kept, pa.binary()), pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

        found = joined.mapInArrow(released(clean), f"doc_id {kind}, n_words long, n_removed long, kept string")
        if sum(level == 0 for level in self.runs.values()) >= self.fan_in:
            self.compact(0)
        return found

    def _append(self, out: DataFrame, number: int) -> None:
        out = out.select("grp", "doc", "prints", F.lit(number).alias("run"), "kind")
        w = out.write.format("parquet").mode("append").partitionBy("run", "kind").bucketBy(self.buckets, "grp")
        with dropping_shuffles(self.spark):
            w.saveAsTable(self.name)

    def compact(self, level: int) -> None:
        """Merges the runs of a level into one of the next; old runs are dropped once the new one is whole."""
        old = [n for n, x in self.runs.items() if x == level]
        number = self.next
        self.next += 1

        def merge(key, table):
            prints, proofs = (np.concatenate(x) for x in zip(*map(unpack, table.column("prints").to_pylist())))
            order = _sorted(prints, proofs)
            prints, proofs = prints[order], proofs[order]
            first = _firsts(prints, proofs)
            out = _rows(key[0].as_py(), prints[first], proofs[first])
            return _freed(pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), _OUT)], schema=_OUT))

        runs = self.spark.table(self.name).where(F.col("run").isin(*old) & (F.col("kind") == _ENTRY)).select("grp", "prints")
        self._append(runs.groupBy("grp").applyInArrow(merge, "kind int, grp int, doc long, prints binary"), number)
        for n in old:
            del self.runs[n]
        self.runs[number] = level + 1
        self._save()
        for n in old:
            self._drop(n, _ENTRY)
        if sum(x == level + 1 for x in self.runs.values()) >= self.fan_in:
            self.compact(level + 1)

    def _drop(self, number: int, kind: int) -> None:
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (run={number}, kind={kind})")
        drop_path(self.spark, f"{self.path}/run={number}/kind={kind}")

    def _drop_run(self, number: int) -> None:
        self._drop(number, _ENTRY)
        self._drop(number, _HIT)
        drop_path(self.spark, f"{self.path}/run={number}")

    def drop_hits(self) -> None:
        """Drops the hits of the last batch, once its result has been used."""
        if self.last is not None:
            self._drop(self.last, _HIT)

    def close(self) -> None:
        """Takes the index's table out of the catalog; the runs stay unless they are in the scratch folder."""
        self.drop_hits()
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if self.own:
            drop_path(self.spark, self.path)


def group_bits_for(total_bytes: int, group_bytes: int = GROUP_BYTES) -> int:
    return min(20, max(6, int(np.ceil(np.log2(max(1, total_bytes / group_bytes))))))


def batch_edges(docs: DataFrame, batches: int) -> list[int]:
    """doc_ids that part docs into about equal batches in ascending order; fewer if ids repeat."""
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / batches for k in range(1, batches)], 10000)).first()[0] or []
    return sorted(set(found))


def dedup_substrings(docs: DataFrame, batches: int | None = None, window: int = WINDOW, path: str | None = None):
    """Feeds docs to an index in batches of ascending doc_id; yields each batch's result (see FingerprintIndex.dedup) before
    the next is begun. A caller that needs it later has to store it. There are BATCHES batches, or more so that none has
    over BATCH_BYTES of text; each reads the rows of its ids, so docs that are laid out by id are read twice in all. path:
    an index to open or to keep; by default there is one for this call only."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    index = FingerprintIndex(docs.sparkSession, group_bits_for(total), window, path)
    edges = batch_edges(docs, batches or max(BATCHES, -(-total // BATCH_BYTES)))
    n = F.col("doc_id")
    try:
        for low, high in zip([None, *edges], [*edges, None]):
            # plain comparisons, which reach the scan; null ids are in the first batch
            part = docs if low is None else docs.where(n > low)
            yield index.dedup(part if high is None else part.where(n <= high if low is not None else (n <= high) | n.isNull()))
            index.drop_hits()
    finally:
        index.close()
