"""Changes to keyed vectors as DataFrame operations: upserts, deletes, outcomes, compaction of a change log.

A log has rows (seq, op, key, vector): op is "insert" (an upsert), "delete", or "set".
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import IndexFull, KeyAlreadyExists
from ..sources.scratch import kept


def latest(log: DataFrame) -> DataFrame:
    """The last change of each key, by seq. One row a key and partition goes into the shuffle."""
    rest = [c for c in log.columns if c not in ("key", "seq")]
    last = log.groupBy("key").agg(F.max_by(F.struct("seq", *rest), "seq").alias("_l"))
    return last.select("key", "_l.*")


def upsert(base: DataFrame, log: DataFrame) -> DataFrame:
    """base (key, vector) after the log's changes: rows that it doesn't name, and the last insert of each key whose last
    change isn't a delete."""
    return replace(base, latest(log))


def replace(base: DataFrame, last: DataFrame) -> DataFrame:
    """upsert by the last change of each key."""
    return base.select("key", "vector").join(last.select("key"), "key", "left_anti").unionByName(last.where("op != 'delete'").select("key", "vector"))


def insert_new(base: DataFrame, rows: DataFrame, tombstones: DataFrame | None = None, capacity: int | None = None) -> DataFrame:
    """base with rows added; refused if a key is there already, deleted or not, or comes twice, or if there would be more
    than `capacity` rows."""
    if capacity is not None and base.count() + rows.count() > capacity:
        raise IndexFull(f"at most {capacity} rows")
    known = base.select("key") if tombstones is None else base.select("key").union(tombstones.select("key"))
    twice = rows.groupBy("key").count().where("count > 1").select("key")
    clash = rows.select("key").join(known, "key", "left_semi").union(twice).limit(1).collect()
    if clash:
        raise KeyAlreadyExists(str(clash[0].key))
    return base.select("key", "vector").unionByName(rows.select("key", "vector"))


def set_outcomes(base: DataFrame, tombstones: DataFrame, rows: DataFrame) -> DataFrame:
    """What setting each row's key does: key, outcome (Inserted, Updated, Resurrected)."""
    had = base.select("key").distinct().withColumn("_had", F.lit(True))
    dead = tombstones.select("key").distinct().withColumn("_dead", F.lit(True))
    out = rows.select("key").distinct().join(had, "key", "left").join(dead, "key", "left")
    return out.select("key", F.when(F.col("_dead"), "Resurrected").when(F.col("_had"), "Updated").otherwise("Inserted").alias("outcome"))


def delete_outcomes(base: DataFrame, tombstones: DataFrame, keys: DataFrame) -> DataFrame:
    """key, deleted: true only if the key was live."""
    live = live_rows(base, tombstones).select("key").distinct().withColumn("_live", F.lit(True))
    return keys.select("key").distinct().join(live, "key", "left").select("key", F.coalesce("_live", F.lit(False)).alias("deleted"))


def live_rows(base: DataFrame, tombstones: DataFrame) -> DataFrame:
    return base.join(tombstones.select("key").distinct(), "key", "left_anti")


def counts(base: DataFrame, tombstones: DataFrame) -> DataFrame:
    """One row: total, deleted, live, next_id (one over the greatest id if base has ids, else over the total)."""
    dead = tombstones.select("key").distinct().withColumn("_dead", F.lit(1))
    d = base.join(dead, "key", "left")
    n = F.coalesce(F.max("id"), F.lit(0)) + 1 if "id" in base.columns else F.count(F.lit(1)) + 1
    total, gone = F.count(F.lit(1)), F.count("_dead")
    return d.agg(total.alias("total"), gone.alias("deleted"), (total - gone).alias("live"), n.cast("long").alias("next_id"))


def with_ids(rows: DataFrame, start: int = 1, few: bool = False) -> DataFrame:
    """rows with `id`: dense numbers from `start` in the order of their keys. Sorted in ranges; offsets of the ranges come from
    their sizes. few: one task sorts and numbers them, without other jobs."""
    if few:
        return rows.repartition(1).sortWithinPartitions("key").withColumn("id", F.monotonically_increasing_id() + start)
    parts = rows.repartitionByRange("key").sortWithinPartitions("key").withColumn("_m", F.monotonically_increasing_id())
    shift = F.lit(1 << 33)
    parts = parts.withColumn("_p", F.floor(F.col("_m") / shift)).withColumn("_o", F.col("_m") % shift).drop("_m")
    parts = kept(parts)
    sizes = {r["_p"]: r["count"] for r in parts.groupBy("_p").count().collect()}  # as many as ranges
    before = list(accumulate((sizes.get(p, 0) for p in range(max(sizes, default=0))), initial=start))
    return parts.withColumn("id", F.element_at(F.lit(before).cast("array<long>"), (F.col("_p") + 1).cast("int")) + F.col("_o")).drop("_p", "_o")
