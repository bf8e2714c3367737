"""SimHash near-duplicates: exact pairs of near fingerprints by a vantage-point tree.

Fingerprints are 64-bit sums of hashed 3-word shingles. Equal fingerprints are merged first. The rest is dealt out by a
vantage-point tree: a node sends fingerprints within `mu` bits of its vantage point to one side, all others to the other.
By the triangle inequality two fingerprints within `radius` bits can only be parted if the nearer one lies within
`radius` of that border; it is sent to the far side as well, as a guest. So every near pair meets in some leaf, as two
residents or as a resident and a guest, and no other leaf is looked at. The tree's upper part is built from a bounded
sample of fingerprints; all fingerprints are dealt out by it, and again by branches built inside nodes that stay too large.
A task deals its node out further, one branch at a time, before it compares. Leaves link what they find as stars, not as
all pairs, and components are found over those links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, _trim, released, stored, text_bytes
from .components import connected_components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Residents that a shuffled leaf should have at most, most fingerprints sampled (by smallest hash) to build the tree in the driver.
LEAF, SAMPLE = 1 << 17, 1 << 17
#: Residents that a task compares all with all; rows of a shuffled leaf beyond which it is compared in pairs of chunks.
LOCAL, GROUP = 128, 1 << 22
#: Residents sampled to part a node further, and levels of its branch.
BRANCH, BRANCH_DEPTH = 4096, 6
_HASHES_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes) -> list[int]:
    """XXH64 of the space-joined 3-word shingles; of the whole sequence if it is shorter; none without words."""
    words = text.translate(LOWER).split()
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return [h(b" ".join(words), SEED)]
    return [h(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])]


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """uint64 fingerprint of each text: a bit is 1 if over half of the hashes have it; 0 without words."""
    out = np.zeros(len(texts), np.uint64)
    pending: list[int] = []
    owners: list[tuple[int, int]] = []
    sums: dict[int, np.ndarray] = {}
    totals: dict[int, int] = {}

    def flush(finished: int) -> None:
        """Adds pending hashes to the sums; texts up to `finished` are complete."""
        if pending:
            bits = np.unpackbits(np.array(pending, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            for (n, _), part in zip(owners, np.add.reduceat(bits, [a for _, a in owners], axis=0, dtype=np.int32)):
                sums[n] = sums[n] + part if n in sums else part.astype(np.int64)
            pending.clear()
            owners.clear()
        for n in [n for n in sums if n <= finished]:
            out[n] = np.packbits(sums.pop(n) * 2 > totals.pop(n), bitorder="little").view("<u8")[0]

    for n, t in enumerate(texts):
        h = shingle_hashes(t)
        totals[n] = len(h)
        for a in range(0, len(h), _HASHES_AT_ONCE):
            owners.append((n, len(pending)))
            pending += h[a : a + _HASHES_AT_ONCE]
            if len(pending) >= _HASHES_AT_ONCE:
                flush(n - 1)
    flush(len(texts))
    return out


def fingerprint_table(docs: DataFrame, carry: Column | None = None) -> DataFrame:
    """Rows (row, fp): what `carry` is (default: doc_id), and the fingerprint as a signed long."""
    d = docs.select((F.col("doc_id") if carry is None else carry).alias("row"), text_bytes().alias("_x"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                fp = fingerprints(part.column(1).to_pylist()).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["row", "fp"])

    return d.mapInArrow(released(run), f"row {d.schema['row'].dataType.simpleString()}, fp long")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """The upper part of a vantage-point tree, as a heap: node n has children 2n+1 (near) and 2n+2 (far)."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 5):
        self.depth = depth
        rng = np.random.default_rng(seed)
        self.points, self.mu = np.zeros((1 << depth) - 1, np.uint64), np.full((1 << depth) - 1, 64, np.int16)
        parts = {0: sample}
        for n in range((1 << depth) - 1):
            part = parts.pop(n)
            if not len(part):
                parts[2 * n + 1] = parts[2 * n + 2] = part
                continue
            # of some candidates the one whose distances spread most
            tries = part[rng.integers(0, len(part), min(8, len(part)))]
            some = part[rng.integers(0, len(part), min(512, len(part)))]
            best = max(tries, key=lambda p: float(distances(some, p).std()))
            d = distances(part, best)
            self.points[n], self.mu[n] = best, int(np.median(d))
            parts[2 * n + 1], parts[2 * n + 2] = part[d <= self.mu[n]], part[d > self.mu[n]]

    def deal(self, fps: np.ndarray, radius: int, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, is resident) for all leaves that each fingerprint has to be in; home: those that are residents, all
        by default."""
        row, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool) if home is None else home
        for _ in range(self.depth):
            d, mu = distances(fps[row], self.points[node]).astype(np.int16), self.mu[node]
            near, edge = d <= mu, d + radius > mu
            # residents go to their side; the near ones by the border are guests beyond it. Guests go wherever a
            # resident within radius may be.
            to_near = np.where(home, near, d <= mu + radius)
            to_far = np.where(home, ~near, edge)
            guest = home & near & edge
            row, node, home = (
                np.concatenate((row[to_near], row[to_far], row[guest])),
                np.concatenate((2 * node[to_near] + 1, 2 * node[to_far] + 2, 2 * node[guest] + 2)),
                np.concatenate((home[to_near], home[to_far], np.zeros(int(guest.sum()), bool))),
            )
        return row, node - ((1 << self.depth) - 1), home


def leaf_links(residents: np.ndarray, guests: np.ndarray, radius: int, cells: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, least fp of its group in this leaf) from all pairs resident-resident and resident-guest."""
    points = np.concatenate((residents, guests))
    label = np.arange(len(points))
    step = max(1, cells // max(1, len(points)))
    for at in range(0, len(residents), step):
        part = residents[at : at + step]
        near = distances(part[:, None], points[None, at:]) <= radius
        for i in np.flatnonzero(near.sum(axis=1) > 1):
            labels = np.unique(label[at:][near[i]])
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels[0]
    # a guest may be in the leaf once only, a group's root is its least fingerprint
    values = points.view(np.int64)
    root = np.full(len(points), np.iinfo(np.int64).max)
    np.minimum.at(root, label, values)
    root = root[label]
    linked = root != values
    return values[linked], root[linked]


def local_links(home: np.ndarray, guest: np.ndarray, radius: int, limit: int = LOCAL) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of one leaf, whose residents and guests are dealt out further by nodes of its own, one branch at a time, until
    at most `limit` residents are left. A branch that its best vantage point hardly parts is compared as it is."""
    stack = [(home, guest, 0)]
    while stack:
        home, guest, level = stack.pop()
        if len(home) > limit:
            tree = VantageTree(home[:: max(1, len(home) // 2048)], 1, seed=level)
            d, e, mu = distances(home, tree.points[0]).astype(np.int16), distances(guest, tree.points[0]).astype(np.int16), tree.mu[0]
            near, edge = d <= mu, d + radius > mu
            sides = (home[near], guest[e <= mu + radius]), (home[~near], np.concatenate((home[near & edge], guest[e + radius > mu])))
            # worth it if it saves comparisons
            if sum(len(h) * (len(h) + len(g)) for h, g in sides) < 0.9 * len(home) * (len(home) + len(guest)):
                stack += [(h, g, level + 1) for h, g in sides if len(h)]
                continue
        yield leaf_links(home, guest, radius)


def _dealt(rows: DataFrame, radius: int, leaf: int, sample: int) -> DataFrame:
    """rows (node, fp, home), which are one node's, dealt out by a tree: a table (node long, fp, home).

    The tree is built on the driver from a bounded sample, so one round has at most log2(sample / 16) levels. Nodes that
    still have over 4 * leaf residents are dealt out again: samples of `BRANCH` residents meet in a task a node, which
    builds that node's branch, and rows meet their branch in parts of bounded size. That goes on until no node is too
    large or none gets smaller.
    """
    spark = rows.sparkSession
    total = rows.count()
    # small tables are parted further, so that all cores have work
    leaf = min(leaf, max(4096, total // (2 * spark.sparkContext.defaultParallelism)))
    some = np.asarray(rows.select("fp").orderBy(F.xxhash64("fp")).limit(min(sample, max(1, total))).toArrow().column("fp")).astype(np.int64).view(np.uint64)
    depth = max(0, min(int(np.ceil(np.log2(max(1, total / leaf)))), int(np.log2(max(1, len(some) / 16)))))
    sent = spark.sparkContext.broadcast(VantageTree(some, depth))

    def deal(batches):
        for b in batches:
            f = np.asarray(b.column(0)).astype(np.int64).view(np.uint64)
            row, to, home = sent.value.deal(f, radius)
            yield pa.RecordBatch.from_arrays([pa.array(to + (1 << depth)), pa.array(f[row].view(np.int64)), pa.array(home)], names=["node", "fp", "home"])

    def branch(key, table):
        f = np.asarray(table.column("fp")).view(np.uint64)
        tree = VantageTree(f, BRANCH_DEPTH)
        return pa.table({"node": pa.array([key[0].as_py()]), "points": pa.array([tree.points.view(np.int64).tolist()], pa.list_(pa.int64())), "mu": pa.array([tree.mu.tolist()], pa.list_(pa.int16()))})

    def further(key, table, trees):
        tree = VantageTree.__new__(VantageTree)
        tree.depth, tree.points, tree.mu = BRANCH_DEPTH, np.array(trees.column("points")[0].as_py(), np.int64).view(np.uint64), np.array(trees.column("mu")[0].as_py(), np.int16)
        f, home = np.asarray(table.column("fp")).view(np.uint64), np.asarray(table.column("home"))
        row, to, own = tree.deal(f, radius, home)
        return pa.table({"node": pa.array((int(key[0].as_py()) << BRANCH_DEPTH) + to), "fp": pa.array(f[row].view(np.int64)), "home": pa.array(own)})

    out = stored(rows.select("fp").mapInArrow(deal, "node long, fp long, home boolean"), "dealt")
    done, before = None, None
    while True:
        sizes = stored(out.groupBy("node").agg(F.count(F.when(F.col("home"), 1)).alias("n"), F.count(F.lit(1)).alias("all")), "nodes")
        # node numbers have 63 bits: a level a bit
        large = sizes.where((F.col("n") > 4 * leaf) & (F.col("node") < F.lit(1 << (62 - BRANCH_DEPTH))))
        now = large.agg(F.sum("n"), F.max("n")).first()
        if now[0] is None or before is not None and now[1] > 0.9 * before:
            break
        before = now[1]
        fine = out.join(large.select("node"), "node", "left_anti")
        done = fine if done is None else done.unionByName(fine)
        heavy = out.join(large, "node")
        # a hash below BRANCH of n is one of about BRANCH residents
        share = F.pmod(F.xxhash64(F.lit(9), "fp"), F.col("n")) < BRANCH
        trees = heavy.where(F.col("home") & share).select("node", "fp").groupBy("node").applyInArrow(branch, "node long, points array<long>, mu array<short>")
        parts = F.ceil(F.col("all") / F.lit(8.0 * leaf)).cast("int")
        trees = stored(trees.join(large, "node").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("node", "part", "points", "mu"), "branches")
        split = heavy.withColumn("part", F.pmod(F.xxhash64(F.lit(8), "fp"), parts).cast("int")).select("node", "part", "fp", "home")
        out = stored(split.groupBy("node", "part").cogroup(trees.groupBy("node", "part")).applyInArrow(further, "node long, fp long, home boolean"), "dealt")
    return out if done is None else done.unionByName(out)


def near_links(fps: DataFrame, radius: int = RADIUS, leaf: int = LEAF, sample: int = SAMPLE, group: int = GROUP) -> DataFrame:
    """Links (a, b) among distinct fingerprints `fp` that join exactly those that lie within radius bits of each other.

    A link says that both are in one group of near ones, not that they are near themselves. A node with more than `group`
    rows, guests included, is cut into chunks by a hash, and each pair of chunks is compared in a task of its own: no task
    holds over about 2 * group rows, however many a node has.
    """
    dealt = _dealt(fps, radius, leaf, sample)
    big = stored(dealt.groupBy("node").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > group).select("node", F.ceil(F.col("_n") / F.lit(float(group))).cast("int").alias("_k")), "bignodes")
    chunk = F.pmod(F.xxhash64(F.lit(7), "fp"), F.col("_k")).cast("int")
    rows = dealt.join(big, "node", "left").withColumn("_c", F.coalesce(chunk, F.lit(0)))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_k"), F.lit(1)) - 1)))
    rows = rows.select("node", F.least("_c", "_o").alias("low"), F.greatest("_c", "_o").alias("high"), "fp", "home")

    def link(table: pa.Table) -> pa.Table:
        f, home = np.asarray(table.column("fp")).view(np.uint64), np.asarray(table.column("home"))
        a, b = (np.concatenate(x) for x in zip(*local_links(f[home], f[~home], radius)))
        _trim()
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return rows.groupBy("node", "low", "high").applyInArrow(link, "a long, b long")


def _rooted(groups: DataFrame, radius: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """groups (fp, first) as (fp, root, first), and the roots of fingerprints that are linked with another."""
    roots = stored(connected_components(near_links(groups, radius, leaf)), "roots")
    named = groups.join(roots, groups.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    return named, roots.select("root").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """Fingerprint and component of every row of docs: doc_id, fp long, component_id.

    component_id is the smallest doc_id that can be reached over links of at most `radius` differing bits. Documents
    without words, null ones too, have fingerprint 0 and are linked by it like any other. Repeated rows have the same
    fingerprint and give one row each. Null ids can't name a component: it is null only if all its members' are. An
    empty table gives no rows. Extra columns aren't read.
    """
    table = stored(fingerprint_table(docs).withColumnRenamed("row", "doc_id"), "fps")
    groups = stored(table.groupBy("fp").agg(F.min("doc_id").alias("first")), "fpgroups")
    named, roots = _rooted(groups, radius, leaf)
    least = named.join(roots, "root", "left_semi").groupBy("root").agg(F.min("first").alias("component_id"))
    component = named.join(least, "root", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return table.join(component, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """One row of each component of near_duplicates, the one of smallest doc_id (nulls last), with all its columns.

    Of rows with equal ids one stays. Rows get a key that is written with them, so what is kept doesn't depend on how
    often they are read.
    """
    row = F.struct(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all"), F.monotonically_increasing_id().alias("key"))
    table = stored(fingerprint_table(docs, row).select("row.all", "row.key", "fp"), "fprows")
    first = F.min(F.struct(F.col("all.doc_id").isNull().alias("no_id"), F.col("all.doc_id").alias("doc_id"), "key"))
    groups = stored(table.groupBy("fp").agg(first.alias("first")), "fpgroups")
    named, _ = _rooted(groups, radius, leaf)
    keys = named.groupBy("root").agg(F.min("first").alias("first")).select("first.key")
    return table.join(keys, "key", "left_semi").select("all.*")
