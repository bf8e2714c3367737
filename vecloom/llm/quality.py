"""Quality rules: hashed n-gram log-likelihood ratios and plain text rules, in built-in functions only.

Two multinomials over hashed unigrams and bigrams are counted: one over a trusted target (documents that `labels` gives
quality 1), one over the whole raw corpus. A document's score is the mean, over its n-grams, of the log ratio of their
smoothed probabilities. A document is kept if it passes the base rules and its score isn't below a fixed threshold.

Everything is column expressions: counting explodes n-grams into a map-side aggregate of at most `buckets` groups a task;
scoring looks buckets up in one array of `buckets` floats, a scalar subquery. Documents are never shuffled or sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, words

#: Hash buckets of the n-gram model: its size, whatever the corpus.
BUCKETS = 1 << 16
#: Trusted documents used at most, those of smallest hashed id. The raw corpus has no such bound.
TRUSTED_DOCS = 50_000
#: Mean log ratio (nats an n-gram) below which a document is dropped.
THRESHOLD = -0.15
_MARKS = "[#*$%&|<>]"


def _ngrams(w: Column, buckets: int) -> Column:
    """Bucket numbers of all unigrams and bigrams of the word array w."""
    m = F.lit(buckets)
    one = F.transform(w, lambda x: F.pmod(F.xxhash64(x), m).cast("int"))
    two = F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.pmod(F.xxhash64(F.get(w, i - 1), F.get(w, i)), m).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.concat(one, two)


def ngram_model(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_docs: int = TRUSTED_DOCS, alpha: float = 4.0) -> DataFrame:
    """One row, `llr` array<float>: for each bucket log(P_target / P_raw), both with add-alpha smoothing.

    The target side is shrunk towards the raw one: `alpha * buckets` pseudo-counts are spread as the raw corpus is, so a
    bucket that the target doesn't show because the target is small isn't taken for bad. Without trusted documents all
    ratios are 0.
    """
    trusted = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_t")).distinct()
    trusted = trusted.orderBy(F.xxhash64("_t"), "_t").limit(trusted_docs)
    d = docs.select("doc_id", words(F.col("text")).alias("_w"))
    d = d.join(F.broadcast(trusted), d.doc_id == trusted._t, "left")
    grams = d.select(F.col("_t").isNotNull().cast("long").alias("_is"), F.explode(let(F.col("_w"), lambda w: _ngrams(w, buckets))).alias("_b"))
    counts = grams.groupBy("_b").agg(F.count(F.lit(1)).alias("_raw"), F.sum("_is").alias("_good"))
    rows = F.sort_array(F.collect_list(F.struct("_b", "_raw", "_good")))
    packed = counts.agg(rows.alias("_rows"), F.coalesce(F.sum("_raw"), F.lit(0)).alias("_n"), F.coalesce(F.sum("_good"), F.lit(0)).alias("_g"))
    prior = F.lit(float(alpha * buckets))

    def ratio(r: Column) -> Column:
        raw = (r["_raw"] + F.lit(alpha)) / (F.col("_n") + prior)
        return F.log((r["_good"] + prior * raw) / (F.col("_g") + prior) / raw).cast("float")

    ratios = packed.select(F.explode(F.transform("_rows", lambda r: F.struct(r["_b"].alias("b"), ratio(r).alias("v")))).alias("_e")).select("_e.b", "_e.v")
    grid = docs.sparkSession.range(buckets, numPartitions=1).select(F.col("id").cast("int").alias("b"), F.lit(0.0).cast("float").alias("v"))
    full = grid.unionByName(ratios).groupBy("b").agg(F.sum("v").cast("float").alias("v"))
    return full.agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "v"))), lambda r: r["v"]).alias("llr"))


def _window_hash(a: Column, b: Column, c: Column) -> Column:
    return F.xxhash64(a, b, c)


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the array w.

    Window hashes are packed with their positions into one long, as many bits each as the text's length leaves, and sorted;
    neighbours of equal hash are compared word by word. Where some of them differ, a window could stand between two equal
    ones of another: that text's windows are sorted by their words instead. The result is exact for texts of any length.
    """
    n = F.size(w)
    at = F.sequence(F.lit(0), n - 3)
    one = F.lit(1).cast("long")

    def same(i: Column, j: Column) -> Column:
        return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    def covered(pos: Column) -> Column:
        """Words covered by 3-word windows at the sorted positions."""
        def body(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, i: F.when(i + 1 < F.size(p), F.least(F.lit(3), F.get(p, i + 1) - x)).otherwise(F.lit(3))), F.lit(0).cast("long"), lambda a, x: a + x)
        return let(pos, body)

    def by_words() -> Column:
        def order(i: Column, j: Column) -> Column:
            found = F.when(F.get(w, i) < F.get(w, j), -1).when(F.get(w, i) > F.get(w, j), 1)
            for k in (1, 2):
                found = found.when(F.get(w, i + k) < F.get(w, j + k), -1).when(F.get(w, i + k) > F.get(w, j + k), 1)
            return found.otherwise(0)

        def hits(s: Column) -> Column:
            return F.sort_array(F.filter(s, lambda x, i: F.coalesce((i > 0) & same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False))))

        return covered(let(F.array_sort(at, order), hits))

    def packed(bits: Column) -> Column:
        def body(s: Column) -> Column:
            def pos(x: Column) -> Column:
                return x.bitwiseAND(F.call_function("shiftleft", one, bits) - 1).cast("int")

            def alike(x: Column, y: Column) -> Column:
                return F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)

            def twin(x: Column, j: Column) -> Column:
                other = F.get(s, j)
                return F.coalesce(alike(x, other) & same(pos(x), pos(other)), F.lit(False))

            def clash(x: Column, i: Column) -> Column:
                return F.when(i > 0, alike(x, F.get(s, i - 1)) & ~same(pos(x), pos(F.get(s, i - 1)))).otherwise(F.lit(False))

            hits = F.filter(s, lambda x, i: ((i > 0) & twin(x, i - 1)) | twin(x, i + 1))
            return F.when(F.size(F.filter(s, clash)) > 0, by_words()).otherwise(covered(F.sort_array(F.transform(hits, pos))))

        def row(i: Column) -> Column:
            return F.call_function("shiftleft", _window_hash(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits).bitwiseOR(i.cast("long"))

        return let(F.sort_array(F.transform(at, row)), body)

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(F.length(F.bin(n.cast("long"))), packed))


def _judged(docs: DataFrame, labels: DataFrame, threshold: float, buckets: int, trusted_docs: int) -> DataFrame:
    """Rows (_row: all columns of docs, q: counts, score and verdict)."""
    model = ngram_model(docs, labels, buckets, trusted_docs)
    # the scalar subquery's value is one array for all rows
    d = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_x"), words(F.col("text")).alias("_w"), model.scalar().alias("_m"))
    lines = F.filter(F.split(F.col("_x"), "\n"), lambda s: s.rlike("[^\\x20\\x09-\\x0D]"))
    total = let(F.col("_m"), lambda m: F.aggregate(let(F.col("_w"), lambda w: _ngrams(w, buckets)), F.lit(0.0), lambda a, b: a + F.get(m, b).cast("double")))
    n = F.size("_w").cast("long")
    d = d.select(
        "_row",
        n.alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_x", F.lit(_MARKS)).cast("long").alias("n_symbols"),
        let(lines, lambda s: (F.size(s) - F.size(F.array_distinct(s))).cast("long")).alias("n_dup_lines"),
        let(F.col("_w"), _repeat_words).alias("n_repeat_words"),
        F.when(n > 0, total / (2 * n - 1)).otherwise(F.lit(0.0)).alias("score"),
    )
    d = d.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(float(threshold))))
    return d.select("_row", F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score").alias("q"))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, trusted_docs: int = TRUSTED_DOCS) -> DataFrame:
    """Rule counts, score and verdict of every row of docs.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), base_failed, kept (boolean),
    score (double: mean log ratio, 0 for a text without words).

    Null text counts as empty: all counts 0, base_failed. Rows are judged one by one, so repeated rows and null ids give
    one result each. An empty table gives none. Extra columns aren't read.
    """
    d = docs.select("doc_id", "text")
    return _judged(d, labels, threshold, buckets, trusted_docs).select("_row.doc_id", "q.*")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS, trusted_docs: int = TRUSTED_DOCS) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns, whatever their names.

    Null and empty texts go; repeated rows and rows of equal or null ids are judged one by one; a score equal to the
    threshold stays; an empty table gives none."""
    return _judged(docs, labels, threshold, buckets, trusted_docs).where("q.kept").select("_row.*")
