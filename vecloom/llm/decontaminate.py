"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

A benchmark item is cut into windows of 10 consecutive words (a shorter item is one window). A window is a set of word
shingles; a document contains the window only if it has all of them, so the prefix that must be joined is one shingle:
the window's rarest in the corpus. The shingles of all windows are counted over all documents to order them by rarity;
documents are then scanned for prefix shingles only. A match gives the window's only possible place (positional bound),
which has to lie inside the document (length bound), and all its words are compared there.

Benchmark windows are joined in blocks of at most BLOCK (window, item) rows, so what is broadcast has a fixed bound; a
benchmark of one block needs no shuffle of documents at all. Each block takes two scans of documents, one that counts its
shingles and one that looks for its windows; with several blocks documents get a key and are written once for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, batch, released, stored, text_bytes

WINDOW, SHINGLE = 10, 5
#: (window, item) rows that are broadcast at once: about 60 MB at most.
BLOCK = 200_000
#: ASCII bytes that aren't word characters become spaces; capitals become small.
_TABLE = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in LOWER)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case."""
    return text.translate(_TABLE).split()


def item_words(text: Column) -> Column:
    """The same words as an array of strings, by built-in functions."""
    small = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(small, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct rows (item_id string, win array<string>)."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item_id"), item_words(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - window, F.lit(0)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("_w", i + 1, window))).alias("win")).distinct()


class _Block:
    """One block of windows, ready for matching; sent to executors."""

    def __init__(self, rows: list[tuple[str | None, list[str]]]):
        wins: dict[tuple[str, ...], int] = {}
        pairs = sorted({(wins.setdefault(tuple(w), len(wins)), i) for i, w in rows}, key=lambda p: (p[0], p[1] is not None, p[1] or ""))
        self.vocabulary = {w.encode(): n + 1 for n, w in enumerate(dict.fromkeys(x for win in wins for x in win))}
        self.lengths = np.array([len(w) for w in wins], np.int64)
        self.words = np.zeros((len(wins), int(self.lengths.max())), np.int32)
        for n, w in enumerate(wins):
            self.words[n, : len(w)] = [self.vocabulary[x.encode()] for x in w]
        self.items: list[list[str]] = [[] for _ in wins]
        for n, i in pairs:
            if i is not None:
                self.items[n].append(i)
        self.sizes = np.minimum(self.lengths, SHINGLE)
        # all shingles of all windows: hash by shingle length
        self.shingles = {int(k): np.unique(_rolling(self.words[self.sizes == k], int(k), self.lengths[self.sizes == k])[0]) for k in np.unique(self.sizes)}

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Chooses each window's rarest shingle; keeps sorted prefix hashes with their postings."""
        self.prefix = {}
        for k, known in self.shingles.items():
            who = np.flatnonzero(self.sizes == k)
            h, row, off = _rolling(self.words[who], k, self.lengths[who])
            rarity = counts[k][np.searchsorted(known, h)]
            best = np.lexsort((off, rarity, row))
            first = np.unique(row[best], return_index=True)[1]
            best = best[first]
            by = np.argsort(h[best], kind="stable")
            keys, starts = np.unique(h[best][by], return_index=True)
            self.prefix[k] = (keys, np.append(starts, len(by)), who[row[best][by]], off[best][by])

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, with a 0 between texts, and the place where each text starts; 0: not in any window."""
        found, starts, get = [], [0], self.vocabulary.get
        for t in texts:
            found.extend(map(get, split_words(t), repeat(0)))
            found.append(0)
            starts.append(len(found))
        return np.array(found, np.int32), np.array(starts, np.int64)


def _hash(ids: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word numbers, along the last axis."""
    n = ids.shape[-1] - k + 1
    h = np.zeros((*ids.shape[:-1], max(n, 0)), np.uint64)
    for j in range(k):
        h = h * _PRIME + ids[..., j : j + n].astype(np.uint64)
        h ^= h >> np.uint64(29)
    return h


def _rolling(words: np.ndarray, k: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, rows and offsets of all shingles of k words."""
    h = _hash(words, k)
    row, off = np.nonzero(np.arange(h.shape[1])[None, :] + k <= lengths[:, None])
    return h[row, off], row, off


def _places(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with k known words in a row, and their hashes."""
    known = (ids != 0).astype(np.int32)
    run = np.concatenate(([0], np.cumsum(known)))
    at = np.flatnonzero(run[k:] - run[:-k] == k) if len(ids) >= k else np.zeros(0, np.int64)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = h * _PRIME + ids[at + j].astype(np.uint64)
        h ^= h >> np.uint64(29)
    return at, h


def _found(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which h are in the sorted keys, and where."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    to = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    which = np.flatnonzero(keys[to] == h)
    return which, to[which]


def _matches(block: _Block, ids: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Starts and windows of all occurrences."""
    starts, wins = [], []
    for k, (keys, first, win, off) in block.prefix.items():
        at, h = _places(ids, k)
        which, to = _found(keys, h)
        if not len(which):
            continue
        n = first[to + 1] - first[to]
        ends = np.cumsum(n)
        done = 0
        while done < len(which):  # pieces of about `most` candidates
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + most)))
            m = n[done:upto]
            post = np.repeat(first[to[done:upto]] - np.concatenate(([0], np.cumsum(m)[:-1])), m) + np.arange(m.sum())
            s, w = np.repeat(at[which[done:upto]], m) - off[post], win[post]
            inside = (s >= 0) & (s + block.lengths[w] <= len(ids))
            s, w = s[inside], w[inside]
            for length in np.unique(block.lengths[w]):
                q = block.lengths[w] == length
                same = (ids[s[q][:, None] + np.arange(length)] == block.words[w[q], :length]).all(axis=1)
                starts.append(s[q][same])
                wins.append(w[q][same])
            done = upto
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(wins)


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of at most `most` bytes of text, or one row."""
    for b in batches:
        texts = b.column("_x")
        ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
        at = 0
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            part = b.slice(at, upto - at)
            yield part, part.column("_x").to_pylist()
            at = upto


def _block_of(spark, wins: DataFrame, texts: DataFrame, k: int, blocks: int):
    part = wins if blocks == 1 else wins.where(F.pmod(F.xxhash64("item_id", "win"), F.lit(blocks)) == k)
    table = part.select("item_id", "win").toArrow()  # at most about BLOCK rows
    rows = list(zip(table.column("item_id").to_pylist(), table.column("win").to_pylist()))
    if not rows:
        return None
    block = _Block(rows)
    sent = spark.sparkContext.broadcast(block)

    def count(batches):
        total = {n: np.zeros(len(s), np.int64) for n, s in sent.value.shingles.items()}
        for _, texts in _pieces(batches):
            ids, _ = sent.value.ids(texts)
            for n, keys in sent.value.shingles.items():
                which, to = _found(keys, _places(ids, n)[1])
                np.add.at(total[n], to, 1)
        for n, c in total.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), n)), pa.array(some), pa.array(c[some])], names=["k", "at", "n"])

    seen = texts.mapInArrow(count, "k long, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n"))
    counts = {n: np.zeros(len(s), np.int64) for n, s in block.shingles.items()}
    table = seen.toArrow()  # one row of numbers for each shingle of the block
    k, at, n = (np.asarray(table.column(c)) for c in ("k", "at", "n"))
    for size, c in counts.items():
        c[at[k == size]] = n[k == size]
    block.order(counts)
    sent.unpersist()
    return spark.sparkContext.broadcast(block)


def _hits(sent, texts: list[bytes]):
    """Of each text: number of words, spans of hit words (merged), items."""
    block = sent.value
    ids, starts = block.ids(texts)
    s, w = _matches(block, ids)
    edge = np.zeros(len(ids) + 1, np.int32)
    np.add.at(edge, s, 1)
    np.add.at(edge, s + block.lengths[w], -1)
    hit = np.cumsum(edge[:-1]) > 0
    doc = np.searchsorted(starts, s, "right") - 1
    items: dict[int, set[str]] = {}
    for d, x in np.unique(np.stack([doc, w], axis=1), axis=0).tolist():
        items.setdefault(d, set()).update(block.items[x])
    change = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    owner = np.searchsorted(starts, begin, "right") - 1
    return starts, begin, end, owner, items


def _scanned(docs: DataFrame, carry: Column, benchmark: DataFrame, window: int, block_rows: int) -> DataFrame:
    """Rows (row: what `carry` is, n_words, hit_spans, items); see contamination."""
    spark = docs.sparkSession
    carried = docs.select(carry.alias("row"), text_bytes().alias("_x"))
    kind = carried.schema["row"].dataType.simpleString()
    wins = stored(windows(benchmark, window), "windows")
    total = wins.count()
    blocks = -(-total // block_rows)
    tail = "n_words long, hit_spans array<struct<start:long,end:long>>, items array<string>"

    def results(sent, key):
        names = pa.schema([("n_words", pa.int64()), ("hit_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

        def run(batches):
            for part, texts in _pieces(batches):
                if sent is None:
                    columns = {"n_words": [len(split_words(t)) for t in texts], "hit_spans": [[]] * len(texts), "items": [[]] * len(texts)}
                else:
                    starts, begin, end, owner, items = _hits(sent, texts)
                    spans: list[list] = [[] for _ in texts]
                    for b, e, o in zip(begin.tolist(), end.tolist(), owner.tolist()):
                        spans[o].append({"start": b - int(starts[o]), "end": e - int(starts[o])})
                    columns = {"n_words": np.diff(starts) - 1, "hit_spans": spans, "items": [sorted(items.get(n, ())) for n in range(len(texts))]}
                out = batch(columns, names)
                yield pa.RecordBatch.from_arrays([part.column(0), *out.columns], names=[key, *names.names])

        return run

    if blocks <= 1:
        sent = _block_of(spark, wins, carried.select("_x"), 0, 1) if total else None
        return carried.mapInArrow(released(results(sent, "row")), f"row {kind}, {tail}")
    # several blocks: rows get a key that lasts, and each block's findings are merged by it
    keyed = stored(carried.withColumn("_key", F.monotonically_increasing_id()), "keyed")
    found = None
    for k in range(blocks):
        sent = _block_of(spark, wins, keyed.select("_x"), k, blocks)
        one = keyed.select("_key", "_x").mapInArrow(results(sent, "_key"), f"_key long, {tail}")
        found = one if found is None else found.unionByName(one)
    merged = found.groupBy("_key").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("hit_spans"))).alias("_s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # overlapping or touching spans of different blocks become one
    empty = F.array().cast("array<struct<start:long,end:long>>")
    joined = F.aggregate("_s", empty, lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] >= x["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x))))
    return keyed.select("_key", "row").join(merged, "_key").select("row", "n_words", joined.alias("hit_spans"), "items")



def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_rows: int = BLOCK) -> DataFrame:
    """What benchmark items each row of docs contains.

    Returns doc_id, n_words long, hit_spans array<struct<start,end>> (word positions, end exclusive, merged and in
    order), items array<string> (ids of items with an occurring window, sorted as strings).

    Null text, of a document or an item, has no words. Items without words match nothing. Rows with equal item_id count
    as one item; windows of items without an id mark words, but no item is listed for them. Each row of docs, repeated
    ones and null ids too, gives one row. An empty table on either side works. Extra columns aren't read.
    """
    return _scanned(docs, F.col("doc_id"), benchmark, window, block_rows).withColumnRenamed("row", "doc_id")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_rows: int = BLOCK) -> DataFrame:
    """The rows of docs that no benchmark window occurs in, with all their columns, whatever their names.

    Null and empty texts have no windows and stay; rows with equal or null ids are judged one by one, repeated rows alike; an
    empty table gives none, an empty benchmark all rows."""
    return _scanned(docs, F.struct(*(F.col(f"`{c}`") for c in docs.columns)), benchmark, window, block_rows).where(F.size("hit_spans") == 0).select("row.*")
