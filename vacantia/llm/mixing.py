"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; every document of a source is expected so many times
as target / source size says. Within a source the documents lie in a row (by size, so that the
words taken come near the target), their expected copies are summed from the start, one offset per
source is added, and a document is taken once per whole number its stretch crosses.

The row of a source is cut into cells (size, id modulo ``splits``), so that no task sorts or sums
a source: sums over cells of one size, then over the sizes of a source, place each cell, and only
within a cell documents are numbered. Sums are whole multiples of 2**-24, hence the same in any order.

Defined cases: a null source is a source of its own, last in order; null and blank texts have size
0; documents of an empty source get target 0; repeated rows are numbered like other rows; an empty
table gives an empty result; further columns are kept by ``mixed``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.columns import unwrapped, wrapped
from vacantia.llm.words import n_words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SPLITS = 64
BITS = 24


def source_key(source: Column) -> Column:
    """Never null, so that joins and windows share one partitioning."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(_key, source_size, target) from one row (_key, source_size) per source.

    Targets go with the weights up to ``most`` times the source's size: in order of size per weight,
    the sources before a certain one are full and the others share the rest by weight.
    """
    ordered = Window.orderBy(F.col("_key") == "", "_key")  # one row per source
    total = Window.partitionBy()
    listed = sizes.withColumn("weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(ordered) - 1) % len(weights)).cast("int") + 1))
    listed = listed.withColumn("cap", F.col("source_size") * float(most)).withColumn("full_at", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("full_at", "_key").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(upto), F.lit(0.0))
    level = (F.sum("source_size").over(total) * share - before("cap")) / (F.sum("weight").over(total) - before("weight"))
    listed = listed.withColumn("level", level)
    # the first source that stays under its cap at its level sets the level of all
    listed = listed.withColumn("level", F.min_by(
        "level", F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "_key"))).over(total))
    return listed.select("_key", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), "cap")).alias("target"))


def offset(key: Column) -> Column:
    """The source's offset below 1, from its name alone."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def allotted(docs: DataFrame, tie: list[Column], splits: int = SPLITS, **options) -> DataFrame:
    """``docs`` (with doc_id, source, size) and _key, source_size, target and copies of each row."""
    cells = ["_key", "size", "_cell"]
    keyed = docs.withColumn("_key", source_key(F.col("source"))).withColumn(
        "_cell", F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(splits)).cast("int"))
    counts = keyed.groupBy(*cells).agg(F.count("*").alias("n"))
    by_size = counts.groupBy("_key", "size").agg(F.sum("n").alias("n"))
    goal = targets(by_size.groupBy("_key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), **options)
    prior = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_size = by_size.withColumn("first", prior(Window.partitionBy("_key").orderBy("size"))).drop("n")
    counts = counts.withColumn("within", prior(Window.partitionBy("_key", "size").orderBy("_cell"))).drop("n")
    placed = counts.join(by_size, ["_key", "size"]).join(goal, "_key").select(
        *cells, "source_size", "target", (F.col("first") + F.col("within")).alias("_first"))
    number = F.row_number().over(Window.partitionBy(*cells).orderBy("doc_id", *tie)) + F.col("_first")
    each = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * (1 << BITS))).otherwise(F.lit(0)).cast("long")
    crossed = lambda n: F.shiftright(n * F.col("_each") + offset(F.col("_key")), BITS)
    return (
        keyed.join(placed, cells).withColumn("_number", number.cast("long")).withColumn("_each", each)
        .withColumn("copies", crossed(F.col("_number")) - crossed(F.col("_number") - 1))
        .drop("_cell", "_first", "_number", "_each"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return allotted(sized, [], **options).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, columns unchanged."""
    held = wrapped(docs, F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie"))
    out = allotted(held, [F.col("_tie")], **options).filter("copies > 0")
    return unwrapped(out.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))), docs.columns)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, coalesce('=' || source, '') AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (SELECT k, sum(size)::BIGINT AS source_size FROM sized GROUP BY k),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY k = '', k) - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER upto, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER upto, 0)) AS level
  FROM weighed WINDOW upto AS (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT k, source_size, least(cap, coalesce((SELECT level FROM levels WHERE level <= cap / w ORDER BY cap / w, k LIMIT 1) * w, cap)) AS target FROM levels),
numbered AS (
  SELECT doc_id, k, size, row_number() OVER (PARTITION BY k ORDER BY size, ((coalesce(doc_id, 0) % 64) + 64) % 64, doc_id NULLS FIRST) AS n FROM sized),
steps AS (
  SELECT doc_id, size, source_size, target, n, CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216)::BIGINT ELSE 0 END AS e,
    ('0x' || substr(md5(k), 1, 6))::BIGINT AS o FROM numbered JOIN goal USING (k))
SELECT doc_id, size::BIGINT AS size, source_size, target,
  ((((n * e + o) >> 24) - (((n - 1) * e + o) >> 24)) * size)::BIGINT AS taken FROM steps"""
