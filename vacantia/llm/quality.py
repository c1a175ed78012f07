"""Quality rules: counts per text, and a hashed n-gram log-likelihood ratio of trusted to raw text.

Everything here is Spark columns. Two multinomials over hashed word unigrams and bigrams are
counted, one over all rows (raw) and one over trusted rows. A text's score is the mean of
``log(p_trusted / p_raw)`` over its n-grams, and texts below a fixed threshold are rejected, each
decision depending on the text and the two tables only. The trusted counts are brought to the size
of the raw ones and ``prior`` is added to every bucket of both, so rare buckets have ratios near 0.

Defined cases: a null or blank text has no words, score 0 and fails the base rules; repeated rows
count as often as they occur; without trusted rows every ratio is 0 and only the base rules
decide; further columns of the input are left alone by ``reject``.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.words import words_of

#: Size of the hashed n-gram tables; both fit in memory anywhere.
BUCKETS = 1 << 16
#: Trusted rows that the target is fitted on: so many, taken by hash of their id.
TRUSTED_ROWS = 20_000
#: Added to each bucket of both tables: a bucket seen a few times only says little.
PRIOR = 16.0
THRESHOLD = -0.1
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT = 20, 8, 30


def bound(value: Column, body) -> Column:
    """``body(value)`` with value computed once: Spark evaluates a lambda's argument a single time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_keys(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def paired(keys: Column, apart: int) -> Column:
    """Each key hashed with the one ``apart`` places on; the last ``apart`` places say nothing."""
    return bound(keys, lambda k: F.transform(k, lambda x, i: F.xxhash64(x, F.get(k, i + apart))))


def repeated_words(pairs: Column) -> Column:
    """Words that lie in an 8-word window found twice or more in the text, from the keys of word pairs."""

    def covered(windows: Column) -> Column:
        def of_sorted(found: Column) -> Column:
            # neighbours in hash order with equal hashes are repeats
            same = lambda i, j: F.coalesce(F.get(found, i)["h"] == F.get(found, j)["h"], F.lit(False))
            places = F.array_sort(F.transform(
                F.filter(found, lambda p, i: same(i, i - 1) | same(i, i + 1)), lambda p: p["i"]))
            # each start adds its window, cut where the next one begins
            return bound(places, lambda at: F.aggregate(
                F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))),
                F.lit(0), lambda a, x: a + x))

        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), bound(ordered, of_sorted)).otherwise(F.lit(0))

    eights = paired(paired(pairs, 2), 4)
    return F.when(F.size(pairs) >= WINDOW, bound(
        F.slice(eights, 1, F.greatest(F.size(pairs) - (WINDOW - 1), F.lit(0))), covered)).otherwise(F.lit(0))


def counts(text: Column, words: Column, pairs: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(pairs).cast("long"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def grams(keys: Column, pairs: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of the words and of the word pairs."""
    place = lambda x: F.pmod(x, F.lit(buckets)).cast("int")
    return F.concat(
        F.transform(keys, place), F.transform(F.slice(pairs, 1, F.greatest(F.size(keys) - 1, F.lit(0))), place))


def keyed(docs: DataFrame) -> DataFrame:
    """With the words and the keys of words and word pairs, each computed once."""
    out = docs.withColumn("_words", words_of(F.col("text")))
    return out.withColumn("_keys", word_keys(F.col("_words"))).withColumn("_pairs", paired(F.col("_keys"), 1))


def trusted_sample(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    """At most ``rows`` ids of good rows, by hash: (doc_id)."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """(bucket, ratio) for each bucket that occurs. ``trusted`` is bounded, so it may be broadcast."""
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted.withColumn("good", F.lit(1))), "doc_id", "left")
    table = (
        keyed(marked).select("good", F.explode(grams(F.col("_keys"), F.col("_pairs"), buckets)).alias("bucket"))
        .groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("target")))
    # one row per bucket, so a window over all of them is small
    total = lambda c: F.sum(c).over(Window.partitionBy()).cast("double")
    target = F.col("target") * F.coalesce(total("raw") / F.nullif(total("target"), F.lit(0.0)), F.lit(0.0))
    # both tables at the size of the raw one, then smoothed alike
    ratio = F.log((target + prior) / (F.col("raw") + prior))
    return table.select("bucket", F.when(total("target") > 0, ratio).otherwise(F.lit(0.0)).alias("ratio"))


def as_column(table: DataFrame, buckets: int = BUCKETS) -> Column:
    """The table, of ``buckets`` rows at most, as an array literal (Spark folds the parse)."""
    values = ["0"] * buckets
    for bucket, ratio in table.collect():
        values[bucket] = f"{ratio:.6g}"
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def mean_ratio(ratios: Column, buckets: int = BUCKETS) -> Column:
    return bound(grams(F.col("_keys"), F.col("_pairs"), buckets), lambda g: F.when(F.size(g) > 0, F.aggregate(
        g, F.lit(0.0), lambda a, b: a + F.get(ratios, b)) / F.size(g)).otherwise(F.lit(0.0)))


def scored(docs: DataFrame, ratios: Column, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, the counts, base_failed, llr and kept of every row."""
    found = counts(F.col("text"), F.col("_words"), F.col("_pairs"))
    out = keyed(docs.select("doc_id", "text")).select(
        "doc_id", *[c.alias(k) for k, c in found.items()], mean_ratio(ratios, buckets).alias("llr"))
    return out.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("llr") >= threshold))


def reject(docs: DataFrame, ratios: Column, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that pass the base rules and the ratio test, columns unchanged."""
    # one expression, in which each array is bound once: a filter is pushed down and would copy columns
    def verdict(keys: Column, pairs: Column) -> Column:
        mean = bound(grams(keys, pairs), lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(ratios, b)) / F.size(g))
        return (F.size(keys) >= MIN_WORDS) & (100 * repeated_words(pairs) <= MAX_REPEAT * F.size(keys)) & (mean >= threshold)

    return docs.filter(bound(word_keys(words_of(F.col("text"))), lambda k: bound(paired(k, 1), lambda p: verdict(k, p))))
