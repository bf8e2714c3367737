"""The registered queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, tables
from .decontaminate import contamination
from .editcount import apply_edits, build_trees
from .html import extract_main_text
from .lmscore import score_documents
from .mixing import mix_sources
from .pii import BASE, find_pii, joined
from .quality import quality_rules
from .simhash import near_duplicates
from .substrings import dedup_substrings
from .tokenids import token_ids


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(tables(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = None
    for part in dedup_substrings(tables(spark, sf_dir, "documents")):
        part = stored(part.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256")), "kept")
        found = part if found is None else found.unionByName(part)
    return found


def op3_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract_main_text(tables(spark, sf_dir, "pages"))
    return d.withColumn("n_chars", F.char_length("text").cast("long"))


def op4_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find_pii(tables(spark, sf_dir, "documents"))
    kinds = F.transform("spans", lambda x: x["kind"])
    counts = [(F.size("spans") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return d.select(
        "doc_id", *counts, F.sha2(joined(F.col("spans"), BASE), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"), F.array_join(F.transform("spans", lambda x: x["score"].cast("string")), ",").alias("scores"),
    )


def op5_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(tables(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(tables(spark, sf_dir, "documents")).drop("source")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(tables(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def revision(trees: DataFrame) -> DataFrame:
    """The query's edits: for every document an insertion, a deletion and a replacement at hashed places."""
    n = F.char_length("text").cast("long")

    def edit(seed: int, length: int, new: str):
        start = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), n + 1)
        return F.struct(start.alias("start"), (start + length).alias("end"), F.lit(new).alias("text"))

    return trees.withColumn("edits", F.array(edit(1, 0, " an added remark,"), edit(2, 40, ""), edit(3, 5, "word")))


def op9_edit_aware_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after the revision, and how many leaves were encoded again."""
    before = build_trees(tables(spark, sf_dir, "documents"))
    return apply_edits(revision(before)).select("doc_id", "n_before", "n_tokens", F.char_length("text").cast("long").alias("n_chars"), "n_edits", "n_leaves", "n_encoded")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = contamination(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    d = d.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return d.withColumn("contaminated", F.col("n_hit") > 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_lm_score, op2_substring_dedup, op3_extract_html, op4_find_pii, op5_token_ids, op6_mix_sources, op7_quality_rules, op8_simhash_near_dedup, op9_edit_aware_counts, op10_decontaminate]
    return {f.__name__: f for f in found}


_OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
place AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM place),
least_id AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT win.doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least_id USING (s) WHERE m < win.doc_id),
n AS (SELECT doc_id, count(*) AS k FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(k, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_WORDS10 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS10} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS10} AS w FROM benchmark),
bi AS (SELECT item, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s FROM bi),
sizes AS (SELECT DISTINCT n FROM bw),
place AS (SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM d, sizes),
hit AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM place) JOIN bw USING (n, s)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""


_OP6 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w FROM d GROUP BY source),
r AS (SELECT s.source, s.z, s.w, ((SELECT sum(z) FROM s) - coalesce(sum(3.0 * o.z) FILTER (WHERE o.z / o.w < s.z / s.w), 0)) / sum(o.w) FILTER (WHERE o.z / o.w >= s.z / s.w) AS level
    FROM s, s AS o GROUP BY s.source, s.z, s.w),
l AS (SELECT min_by(level, z / w) AS level FROM r WHERE level * w <= 3.0 * z),
t AS (SELECT source, z, CAST(least(3.0 * z, l.level * w) AS DOUBLE) AS target FROM s, l),
u AS (SELECT *, CASE WHEN z > 0 THEN CAST(least(floor(target / z), 3) AS BIGINT) ELSE 0 END AS rep FROM t),
g AS (SELECT source, h, CAST(sum(size) AS BIGINT) AS k FROM d GROUP BY source, h),
c AS (SELECT *, CAST(sum(k) OVER (PARTITION BY source ORDER BY h) AS BIGINT) AS upto FROM g),
e AS (SELECT c.source, h, z, target, rep, upto <= target - rep * z OR (upto - k <= target - rep * z AND (target - rep * z - upto + k) * 2 > k) AS more
    FROM c JOIN u ON c.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, z AS source_size, target, size * (rep + CAST(more AS BIGINT)) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source AND d.h = e.h
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that DuckDB can express. The others hash, tokenize, parse or learn in ways that it can't; they are
    tested against brute force."""
    return {"op2_substring_dedup": _OP2, "op6_mix_sources": _OP6, "op10_decontaminate": _OP10}
