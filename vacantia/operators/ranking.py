"""Report rows: join, selection, totals, order, rank and the document itself."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vacantia import params as P
from vacantia.functions.report import posting_block, run_stamp
from vacantia.functions.text import filled
from vacantia.params import Params

MATCH_FIELDS = [
    "role_fit_score", "match_reason", "location_tier", "employer_type",
    "sponsorship_confidence", "sponsorship_evidence",
]


def selected_matches(matches: DataFrame, params: Params) -> DataFrame:
    return matches.filter(~F.col("hard_filtered") & (F.col("role_fit_score") >= params.score_threshold))


def report_join(postings: DataFrame, matches: DataFrame, salaries: DataFrame) -> DataFrame:
    """Posting with its match (inner) and its salary if any (left)."""
    return (
        postings.join(matches.select("url_hash", "hard_filtered", *MATCH_FIELDS), "url_hash")
        .join(salaries.select("url_hash", "salary_display"), "url_hash", "left")
    )


def report_rows(state: dict[str, DataFrame], params: Params = Params()) -> DataFrame:
    """Rows that reach the report. All filters run before the joins."""
    postings = state["postings"].filter(F.col("status").isin(*P.REPORTABLE_STATUSES))
    joined = report_join(postings, selected_matches(state["matches"], params), state["salaries"])
    return joined.drop("hard_filtered")


def needs_salary(rows: DataFrame) -> DataFrame:
    """Rows not priced by an earlier run (even "Not disclosed" counts as priced)."""
    return rows.filter("salary_display IS NULL OR salary_display = ''")


def in_known_tier(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("location_tier").isin(1, 2, 3))


def report_totals(rows: DataFrame) -> DataFrame:
    """Rows per tier and overall (tier NULL); other tiers are not reported."""
    return in_known_tier(rows).rollup("location_tier").agg(F.count(F.lit(1)).alias("postings"))


def _score() -> Column:
    return F.coalesce("role_fit_score", F.lit(0))


def ordered(rows: DataFrame) -> DataFrame:
    """Tier, then score from high to low, then key: a range-partitioned sort."""
    return in_known_tier(rows).orderBy("location_tier", _score().desc(), "url_hash")


def tier_rank(rows: DataFrame, prefix_chars: int = 3) -> DataFrame:
    """``rank`` of every row within its tier.

    There are only three tiers, so ranking a whole tier in one window would put a
    third of all rows into one task. Rows are instead ranked inside small buckets
    (tier, score, first hex digits of the key, which are uniform), and a bucket's
    offset is the running count of the buckets before it.
    """
    rows = in_known_tier(rows).withColumn("_score", _score()).withColumn(
        "_bucket", F.substring("url_hash", 1, prefix_chars)
    )
    bucket = ["location_tier", "_score", "_bucket"]
    before = Window.partitionBy("location_tier").orderBy(F.col("_score").desc(), "_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(*bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*bucket).orderBy("url_hash"))
    return (
        rows.withColumn("_inside", inside).join(offsets, bucket)
        .withColumn("rank", F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset", "_score", "_bucket")
    )


def blocks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", posting_block())


def document(rows: DataFrame, fx_label: Column, now: Column) -> DataFrame:
    """The report as ordered text rows (section, part, score, url_hash, text).

    Section 0 is the header, 1..3 are the tiers; part 0 is a tier's heading (with the
    "no matches" line if it is empty), part 1 its blocks. Each row is one piece of
    text and the rows are range-sorted, so a report of any size is written in order
    by many tasks. Pieces are parted by one blank line once a line end follows each.
    """
    shown = in_known_tier(rows)
    spark = rows.sparkSession
    counts = shown.groupBy("location_tier").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    no_key = F.lit("").alias("url_hash")

    header = total.select(
        F.lit(0).alias("section"), F.lit(0).alias("part"), F.lit(0).alias("score"), no_key,
        filled(P.REPORT_HEAD, run_stamp(now), F.col("n").cast("string"), fx_label).alias("text"),
    )
    tiers = spark.createDataFrame(list(P.TIER_HEADINGS.items()), "location_tier INT, heading STRING")
    headings = tiers.join(counts, "location_tier", "left").select(
        F.col("location_tier").alias("section"), F.lit(0).alias("part"), F.lit(0).alias("score"), no_key,
        F.concat(F.lit("\n"), F.col("heading"), F.when(F.col("n").isNull(), f"\n\n{P.NO_MATCHES}").otherwise(""))
        .alias("text"),
    )
    body = blocks(shown).select(
        F.col("location_tier").alias("section"), F.lit(1).alias("part"), _score().alias("score"), "url_hash",
        F.concat(F.lit("\n"), F.col("block")).alias("text"),
    )
    return header.unionByName(headings).unionByName(body).orderBy("section", "part", F.col("score").desc(), "url_hash")
