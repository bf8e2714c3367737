"""Mixing sources to target weights by hash-threshold histograms, in built-in functions.

Each source's target is met by whole repeats of the source plus a hashed part of it: documents whose hash lies below the
source's threshold are taken once more. The threshold is found by nested histograms: words are summed by source and the
hash's first bits; the bucket in which the budget runs out is the only one refined by the next bits, until it holds one
document (or rows that can't be told apart). Documents are filtered by their hash; they are never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: Most times that a source may be repeated.
MAX_REPEATS = 3
#: Bits of the hash that each histogram level looks at, and the number of levels: 60 bits in all.
LEVEL_BITS, LEVELS = 12, 5
_HASH_BITS = LEVEL_BITS * LEVELS


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_REPEATS) -> DataFrame:
    """Targets of sources, from rows (source, source_size).

    Sources in order of code points, null last, get the weights in turn. They share the sum of all sizes by weight, but
    none gets over cap times its size; what that leaves is shared again by weight among the others. That ends at
    min(cap * size, level * weight) with one level for all, found here at once by running sums over size / weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    d = sizes.withColumn("_w", w).withColumn("_cap", F.lit(float(cap)) * F.col("source_size"))
    whole = Window.partitionBy()
    rank = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    after = rank.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    d = d.withColumn("_level", level)
    # the sources that are not capped are those from the first whose own level doesn't exceed its cap
    d = d.withColumn("_free", F.max(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.lit(1)).otherwise(F.lit(0))).over(rank.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_final", F.first(F.when(F.col("_free") == 1, F.col("_level")), ignorenulls=True).over(rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.when(F.col("_free") == 1, F.col("_final") * F.col("_w")).otherwise(F.col("_cap"))
    return d.select("source", "source_size", target.alias("target"))


def _hash(seed: int) -> Column:
    """The first 60 bits of MD5 of seed, id and text, which SQL engines have too."""
    whole = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, _HASH_BITS // 4), 16, 10).cast("long")


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), _hash(seed).alias("_h"))


def mix_plan(d: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_REPEATS) -> DataFrame:
    """(_s, source_size, target, _repeats, _prefix) of each source of d (source, size, _h): a row is taken _repeats
    times, and once more if its hash lies below _prefix."""
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    # a source's plan: whole repeats, what is left for the part, and the bucket being refined
    plan = source_targets(sizes, weights, cap)
    repeats = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("_repeats", repeats).withColumn("_left", F.col("target") - F.col("_repeats") * F.col("source_size"))
    # prefix: bits found so far; the threshold is the first hash not taken
    plan = stored(plan.withColumn("_prefix", F.lit(0).cast("long")).withColumn("_open", F.col("_left") > 0), "mixplan")
    for level in range(LEVELS):
        plan = _refined(d, plan, level)
        if not plan.where("_open").limit(1).count():
            break
    return plan.select(F.col("source").alias("_s"), "source_size", "target", "_repeats", "_prefix")


def _times() -> Column:
    return F.col("_repeats") + F.when(F.col("_h") < F.col("_prefix"), F.lit(1)).otherwise(F.lit(0))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """How much of each row of docs the mix takes: doc_id, source, size, source_size, target, taken.

    size: words of the text, 0 for null. taken: size times the number of times that the row is taken, 0 to cap. Rows
    with the same doc_id and text share a hash and so a fate. Null ids and sources are values like any other. Sources
    without words have target 0 and take nothing. An empty table gives no rows. Extra columns aren't read.
    """
    d = stored(_measured(docs, seed), "mix")  # built once: the passes read only numbers
    limits = mix_plan(d, weights, cap)
    out = d.join(limits, d.source.eqNullSafe(limits._s))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * _times()).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_REPEATS, seed: int = 17) -> DataFrame:
    """The mix itself: each row of docs as many times as mix_sources takes it, with all its columns, whatever their names.

    Null texts have size 0 and share their source's threshold like others; null sources are one source, the last; rows with
    equal id and text have one hash and so one fate; an empty table gives none."""
    limits = mix_plan(stored(_measured(docs, seed), "mix"), weights, cap)
    d = docs.select(F.struct("*").alias("_row"), F.col("source").cast("string").alias("_source"), _hash(seed).alias("_h"))
    d = d.join(limits, d._source.eqNullSafe(limits._s)).withColumn("_n", _times().cast("int"))
    return d.where("_n > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k")).select("_row.*")


def _refined(d: DataFrame, plan: DataFrame, level: int) -> DataFrame:
    """The plan with LEVEL_BITS more bits of each open source's threshold.

    _prefix holds the threshold so far, as a hash; the open bucket is [_prefix, _prefix + width of the level above).
    """
    above, width = 1 << (_HASH_BITS - level * LEVEL_BITS), 1 << (_HASH_BITS - (level + 1) * LEVEL_BITS)
    todo = plan.where("_open").select(F.col("source").alias("_s"), F.col("_prefix").alias("_p"))
    inside = d.join(todo, d.source.eqNullSafe(todo._s)).where((F.col("_h") >= F.col("_p")) & (F.col("_h") - F.col("_p") < F.lit(above)))
    bars = inside.groupBy(F.col("source"), ((F.col("_h") - F.col("_p")) / F.lit(width)).cast("long").alias("_b"))
    bars = bars.agg(F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_docs"), F.min("_h").alias("_lo"), F.max("_h").alias("_hi"))
    # at most 2^LEVEL_BITS rows a source
    bars = bars.withColumn("_upto", F.sum("_words").over(Window.partitionBy("source").orderBy("_b")))
    left = plan.where("_open").select(F.col("source").alias("_s"), F.col("_left").alias("_l"))
    cut = bars.join(left, bars.source.eqNullSafe(left._s)).where((F.col("_upto") - F.col("_words") <= F.col("_l")) & (F.col("_upto") > F.col("_l")))
    cut = cut.select(F.col("source").alias("_s"), "_b", "_words", "_lo", "_hi", (F.col("_l") - F.col("_upto") + F.col("_words")).alias("_rest"))
    p = plan.join(cut, plan.source.eqNullSafe(cut._s), "left")
    found = F.col("_open") & F.col("_b").isNotNull()
    last = (F.col("_lo") == F.col("_hi")) | F.lit(level == LEVELS - 1)
    # a bucket that can't be parted goes in if that brings the total nearer to the target
    start = F.col("_prefix") + F.col("_b") * F.lit(width)
    closed = F.when(F.col("_rest") * 2 > F.col("_words"), F.col("_hi") + 1).otherwise(F.col("_lo"))
    prefix = F.when(found & last, closed).when(found, start).when(F.col("_open"), F.lit(1 << _HASH_BITS).cast("long")).otherwise(F.col("_prefix"))
    out = p.select("source", "source_size", "target", "_repeats", F.when(found, F.col("_rest")).otherwise(F.lit(0.0)).alias("_left"), prefix.alias("_prefix"), (found & ~last).alias("_open"))
    return stored(out, "mixplan")
