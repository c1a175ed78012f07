"""Model verdicts: from a reply text per posting to match columns."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vacantia import params as P
from vacantia.functions import rules, variant as V
from vacantia.functions.text import computed_once
from vacantia.params import Params


VERDICT_KEYS = [
    "is_technical_product_role", "is_marketing_flavored", "seniority_signal", "employer_type",
    "sponsorship_confidence", "sponsorship_evidence", "reason", "role_fit_score",
]


def verdict_fields(f: dict[str, V.Field]) -> dict[str, Column]:
    """Typed fields of a verdict. A missing role flag means true, a null one false;
    a missing score means 0, one that is no number is NULL (= a failed verdict)."""
    score, kind = f["role_fit_score"].text, f["role_fit_score"].kind
    whole = (
        F.when(kind == "STRING", F.when(F.rlike(score, F.lit(r"^\s*[+-]?\d+\s*$")), F.trim(score).try_cast("int")))
        .when(kind == "BOOLEAN", score.try_cast("boolean").cast("int"))
        .otherwise(score.try_cast("double").try_cast("int"))
    )
    return {
        "is_technical_product_role": f["is_technical_product_role"].truthy(missing=True),
        "is_marketing_flavored": f["is_marketing_flavored"].truthy(),
        "seniority_signal": f["seniority_signal"].text,
        "employer_type": f["employer_type"].text,
        "sponsorship_confidence": f["sponsorship_confidence"].text,
        "sponsorship_evidence": f["sponsorship_evidence"].text,
        "reason": f["reason"].get(),
        "role_fit_score": F.when(f["role_fit_score"].missing, F.lit(0)).otherwise(whole),
    }


def apply_verdicts(postings: DataFrame, params: Params = Params(), reply: str = "reply") -> DataFrame:
    """Match columns for postings that carry a model ``reply`` (NULL = no answer).

    Adds ``failed``: the reply was needed and unusable. Such rows get no match and
    stay in the queue. Rows stopped by the keyword gate never need a reply.
    """
    c = F.col
    kept = [c(f"`{name}`") for name in postings.columns if name != reply]
    keyword = rules.hard_filter_reason(c("title"), c("description"), c("employment_type"), params)
    parsed = postings.select(
        *kept, keyword.alias("_keyword"), V.first_object(c(reply)).alias("_v"),
        rules.location_tier(c("location"), c("remote_type"), params).alias("_tier"),
    )
    read, found = V.with_fields(parsed, "_v", VERDICT_KEYS)
    fields = F.struct(*[col.alias(name) for name, col in verdict_fields(found).items()])
    typed = read.select(*kept, "_keyword", "_tier", F.when(c("_v").isNotNull(), fields).alias("f"))
    early = F.coalesce(
        F.when(~c("f.is_technical_product_role"), P.REASON_NOT_PRODUCT),
        F.when(c("f.is_marketing_flavored"), P.REASON_MARKETING),
        rules.seniority_reason(c("f.seniority_signal"), prefix=""),
    )
    late = rules.sponsorship_reason(c("_tier"), c("f.sponsorship_confidence"), params, prefix="")
    gated = typed.select(
        *kept, "_keyword", "_tier", "f", F.when(c("_keyword").isNull(), early).alias("_early"), late.alias("_late"),
    ).select(
        "*",
        (c("_keyword").isNull() & c("_early").isNull()).alias("_reached"),
        F.coalesce("_keyword", "_early", "_late").alias("_reason"),
    )
    passed = c("_reason").isNull()
    return gated.select(
        *kept,
        F.when(passed, rules.employer_penalty(c("f.role_fit_score"), c("f.employer_type"), params)).alias("role_fit_score"),
        F.when(passed, c("f.role_fit_score")).alias("raw_role_fit_score"),
        F.when(c("_keyword").isNull(), c("f.reason")).otherwise("").alias("match_reason"),
        F.when(c("_reached"), c("_tier")).alias("location_tier"),
        F.when(c("_reached"), c("f.employer_type")).alias("employer_type"),
        F.when(c("_reached"), c("f.sponsorship_confidence")).alias("sponsorship_confidence"),
        F.when(c("_reached"), c("f.sponsorship_evidence")).alias("sponsorship_evidence"),
        computed_once(~passed).alias("hard_filtered"),
        c("_reason").alias("hard_filter_reason"),
        computed_once(
            c("_keyword").isNull() & (c("f").isNull() | (passed & c("f.role_fit_score").isNull()))
        ).alias("failed"),
    )


def cut_after_failures(df: DataFrame, batch: str, ord_: str, failed: str, limit: int = 3, width: int = 100_000) -> DataFrame:
    """Keep each batch's rows up to and including the ``limit``-th consecutive failure.

    ``ord_`` is a unique integer position. A batch can be the whole run, so it is
    never sorted in one task: it is cut into chunks of ``width`` positions. A chunk
    finds runs inside itself; only a few numbers per chunk (failures at its start and
    end) are carried across chunk borders.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(ord_) / width))
    in_chunk = Window.partitionBy(batch, "_chunk").orderBy(ord_)
    up_to_here = in_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bad = F.coalesce(F.col(failed), F.lit(False))
    # failures since the last success; `_lead` marks rows before the chunk's first success
    marked = (
        chunked.withColumn("_good", F.sum((~bad).cast("long")).over(up_to_here))
        .withColumn("_lead", F.col("_good") == 0)
    )
    streak = Window.partitionBy(batch, "_chunk", "_good").orderBy(ord_)
    marked = marked.withColumn("_pos", F.row_number().over(streak))
    # behind a success the streak's first row is that success, at the chunk start it is a failure
    run = F.when(F.col("_lead"), F.col("_pos")).otherwise(F.col("_pos") - 1)
    marked = marked.withColumn("_run", run)

    summary = marked.groupBy(batch, "_chunk").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and("_lead").alias("all_bad"),
        F.max_by("_run", ord_).alias("tail"),
        F.min(F.when(~F.col("_lead") & (F.col("_run") == limit), F.col(ord_))).alias("inner"),
        *[F.min(F.when(F.col("_lead") & (F.col("_run") == k), F.col(ord_))).alias(f"lead{k}") for k in range(1, limit + 1)],
    )
    chunks = Window.partitionBy(batch).orderBy("_chunk")
    block = F.sum((~F.col("all_bad")).cast("long")).over(chunks.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carried = (
        summary.withColumn("_block", block)
        .withColumn("_out", F.sum("tail").over(
            Window.partitionBy(batch, "_block").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ))
        .withColumn("_in", F.coalesce(F.lag("_out").over(chunks), F.lit(0)))
    )
    at_start = F.coalesce(*[F.when(F.col("_in") == limit - k, F.col(f"lead{k}")) for k in range(1, limit)], F.col(f"lead{limit}"))
    cut = carried.withColumn("_cut", F.least(at_start, F.col("inner")))
    first_cut = F.min("_cut").over(Window.partitionBy(batch))
    limits = cut.select(batch, "_chunk", first_cut.alias("_stop"))
    kept = chunked.join(limits, [batch, "_chunk"]).filter(F.col("_stop").isNull() | (F.col(ord_) <= F.col("_stop")))
    return kept.select(*df.columns)


def match_totals(queue: DataFrame, matched: DataFrame) -> DataFrame:
    """Passed rows and the size of the whole queue (tried or not)."""
    flags = queue.select(F.lit(1).alias("q"), F.lit(0).alias("p")).unionAll(
        matched.select(F.lit(0), (~F.col("hard_filtered")).cast("int"))
    )
    return flags.agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("passed"), F.coalesce(F.sum("q"), F.lit(0)).alias("queued")
    )
