"""Caller-supplied scoring and estimating functions, run batch-wise on executors.

A reply function takes a list of prompts and returns one item per prompt: the reply
text, or an exception object for a prompt it could not answer. Failures become rows,
never exceptions, so one bad answer does not fail the job.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from vacantia import params as P
from vacantia.functions import variant as V
from vacantia.functions.rules import hard_filter_reason, score_postings
from vacantia.functions.salary import LAKH, format_span
from vacantia.functions.text import filled, text_or_empty
from vacantia.operators.verdicts import apply_verdicts
from vacantia.params import Params
from vacantia.sources.workdir import work_dir

ReplyFunction = Callable[[Sequence[str]], Sequence["str | Exception"]]

NOT_TRIED = "not tried: too many failures in a row"

SCORING_PROMPT = """Judge whether this job posting suits a candidate for technical product \
roles (product owner or product manager, plain or technical) with 5 to 8 years of experience \
in applicant-tracking and HR-technology integrations: B2B SaaS, PaaS and API platforms, OAuth.

Answer with one JSON object and nothing else, using these keys:
  role_fit_score: integer from 0 to 100, fit of the work itself, whoever the employer is
  reason: one sentence about this posting
  is_technical_product_role: true or false
  is_marketing_flavored: true if the actual duties are mainly marketing, whatever the title
  seniority_signal: junior (under 4 years), fits, senior (10 years or more, or director level) or unclear
  employer_type: product (owns what it builds) or service (builds for clients)
  sponsorship_confidence: confirmed, likely or unconfirmed for postings abroad, otherwise null
  sponsorship_evidence: the wording behind it, or null

Title: {title}
Company: {company}
Location: {location}
Source: {source}

{description}
"""

ESTIMATE_PROMPT = """Estimate the yearly total pay for this role in lakhs of Indian rupees, from \
general knowledge of the market. If there is no basis for an estimate, use null.

Answer with one JSON object and nothing else, using these keys:
  min_lpa: number or null
  max_lpa: number or null
  basis: a short phrase

Title: {title}
Company: {company}
Location: {location}
Remote type: {remote_type}
"""


def truncate_description(description: Column, params: Params = Params()) -> Column:
    whole = text_or_empty(description)
    return whole if params.max_description_chars is None else F.substring(whole, 1, params.max_description_chars)


def render(template: str, fields: dict[str, Column]) -> Column:
    """Fill ``{name}`` marks of a template with columns; NULL reads ``None``."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = {name: rest.find("{" + name + "}") for name in fields}
        found = [(pos, name) for name, pos in at.items() if pos >= 0]
        if not found:
            parts.append(F.lit(rest))
            break
        pos, name = min(found)
        parts += [F.lit(rest[:pos]), F.coalesce(fields[name], F.lit("None"))]
        rest = rest[pos + len(name) + 2:]
    return F.concat(*parts)


def scoring_prompt(params: Params = Params(), template: str = SCORING_PROMPT) -> Column:
    fields = {name: F.col(name) for name in ("title", "company", "location", "source")}
    return render(template, fields | {"description": truncate_description(F.col("description"), params)})


def estimate_prompt(template: str = ESTIMATE_PROMPT) -> Column:
    return render(template, {name: F.col(name) for name in ("title", "company", "location", "remote_type")})


def ask(df: DataFrame, key: str, fn: ReplyFunction, chunk: int = 16) -> DataFrame:
    """(key, reply, error) for every row of ``df`` (key, prompt).

    Rows stream through in Arrow batches, in calls of up to ``chunk`` prompts.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prompts = batch["prompt"].tolist()
            replies: list[str | None] = []
            errors: list[str | None] = []
            for start in range(0, len(prompts), chunk):
                asked = prompts[start:start + chunk]
                try:
                    answers = list(fn(asked))
                    if len(answers) != len(asked):
                        raise ValueError(f"{len(asked)} prompts but {len(answers)} answers")
                except Exception as failure:  # a failed call is data, see above
                    answers = [failure] * len(asked)
                for answer in answers:
                    good = isinstance(answer, str)
                    replies.append(answer if good else None)
                    errors.append(None if good else f"{type(answer).__name__}: {answer}")
            yield pd.DataFrame({
                key: batch[key],
                "reply": pd.Series(replies, index=batch.index, dtype="object"),
                "error": pd.Series(errors, index=batch.index, dtype="object"),
            })

    return df.select(key, "prompt").mapInPandas(run, f"{key} string, reply string, error string")


#: Prompts of a wave that one task asks.
ASKED_A_TASK = 256
_ROW_BITS = 33  # of monotonically_increasing_id: the row within its task


def numbered(df: DataFrame, key: str) -> tuple[DataFrame, list[tuple[int, int]], int]:
    """``df`` in order of the key as a written table with ``_id``, the first id and size of each task, and the row count.

    Ids ascend with the key; within a task they have no gaps, so a range of ordinals is a range of ids,
    and a scan for it reads the row groups it needs. The list has an entry per task of the sort.
    """
    spark, path = df.sparkSession, work_dir(df.sparkSession, "queue")
    df.select(key, "prompt").orderBy(key).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    queue = spark.read.parquet(path)
    task = F.shiftright("_id", _ROW_BITS)
    sizes = queue.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).orderBy("task").collect()
    return queue, [(r.task << _ROW_BITS, r.n) for r in sizes], sum(r.n for r in sizes)


def _id_at(tasks: list[tuple[int, int]], ordinal: int) -> int:
    """The id of the row with this ordinal (from 0); one beyond all ids, if there is none."""
    for first, n in tasks:
        if ordinal < n:
            return first + ordinal
        ordinal -= n
    return tasks[-1][0] + tasks[-1][1] if tasks else 0


def ask_until_failing(
    df: DataFrame, key: str, fn: ReplyFunction, max_failures: int, chunk: int = 16, a_task: int = ASKED_A_TASK,
) -> DataFrame:
    """As :func:`ask`, but stops after ``max_failures`` failures in a row, in order of the key.

    Prompts are asked in waves, ranges of ordinals that are written before the next one starts, each over as
    many tasks as it needs. The first wave is as long as the limit; a wave that ends with an answer lets the
    next one be twice as long; one that ends with failures is followed by a wave no longer than failures are
    left to the limit, and an answer there brings the length back. So a broken service is asked
    ``max_failures`` times however the rows are partitioned, and the number of waves grows with the logarithm
    of the queue. The rows that weren't asked come back as not tried.
    """
    queue, tasks, total = numbered(df, key)
    spark, root = df.sparkSession, work_dir(df.sparkSession, "waves")
    asked, in_row, size, number = 0, 0, max_failures, 0
    answered: list[DataFrame] = []
    while asked < total and in_row < max_failures:
        length = min(size if in_row == 0 else max_failures - in_row, total - asked)
        first, behind = _id_at(tasks, asked), _id_at(tasks, asked + length)
        wave = queue.filter((F.col("_id") >= first) & (F.col("_id") < behind)).select(F.col("_id").cast("string").alias("_id"), "prompt")
        path = f"{root}/wave={number}"
        ask(wave.repartition(-(-length // a_task)), "_id", fn, chunk).write.parquet(path)
        done = spark.read.schema("_id string, reply string, error string").parquet(path).withColumn("_id", F.col("_id").cast("long"))
        good = done.filter("error IS NULL").agg(F.max("_id")).first()[0]
        # failures behind the wave's last answer count on
        in_row = in_row + length if good is None else done.filter(F.col("_id") > good).count()
        if good is not None and length == size:
            size *= 2
        answered.append(done)
        asked, number = asked + length, number + 1
    rest = queue.filter(F.col("_id") >= _id_at(tasks, asked)).select(
        key, F.lit(None).cast("string").alias("reply"), F.lit(NOT_TRIED).alias("error"))
    if not answered:
        return rest
    tried = reduce(lambda a, b: a.unionAll(b), answered)
    return queue.select(key, "_id").join(tried, "_id").select(key, "reply", "error").unionByName(rest)


def score(
    postings: DataFrame, params: Params = Params(), fn: ReplyFunction | None = None,
) -> DataFrame:
    """Score postings with the scorer ``params.mode`` names.

    ``heuristic``: the rule scorer. ``llm``: prompts go to ``fn``; rows the keyword
    gate already stops are never asked. Failed rows are left out (they stay queued).
    Without a scorer nothing is scored: everything stays queued.
    """
    if params.mode == "heuristic":
        return score_postings(postings, params)
    if params.mode != "llm":
        raise ValueError(f"unknown scoring mode {params.mode!r}, expected 'heuristic' or 'llm'")
    open_rows = postings.filter(
        hard_filter_reason(F.col("title"), F.col("description"), F.col("employment_type"), params).isNull()
    )
    prompts = open_rows.select("url_hash", scoring_prompt(params).alias("prompt"))
    if fn is None:
        replies = prompts.select("url_hash", F.lit(None).cast("string").alias("reply")).limit(0)
        postings = postings.limit(0)
    elif params.max_failures_in_row is None:
        replies = ask(prompts, "url_hash", fn).drop("error")
    else:
        replies = ask_until_failing(prompts, "url_hash", fn, params.max_failures_in_row).drop("error")
    judged = apply_verdicts(postings.join(replies, "url_hash", "left"), params)
    return judged.filter(~F.col("failed")).drop("failed")


def parse_estimates(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add the pay estimate of a reply; all NULL unless both bounds are numbers."""
    read, f = V.with_fields(df.withColumn("_v", V.first_object(F.col(reply))), "_v", ["min_lpa", "max_lpa", "basis"])
    for name, key in (("_low", "min_lpa"), ("_high", "max_lpa")):
        number = ~f[key].kind.isin("STRING", "BOOLEAN", "VOID")
        read = read.withColumn(name, F.when(number, f[key].text.try_cast("double")))
    low, high = F.col("_low"), F.col("_high")
    both = low.isNotNull() & high.isNotNull()
    return read.select(
        *[c for c in df.columns if c != reply],
        format_span(F.when(both, "estimated"), F.lit(""), low, high).alias("salary_display"),
        F.when(both, low * LAKH).alias("salary_min_inr"),
        F.when(both, high * LAKH).alias("salary_max_inr"),
        F.when(both, filled(P.ESTIMATE_NOTE, f["basis"].shown(missing=P.DEFAULT_BASIS))).alias("source_note"),
    )


def estimate(missed: DataFrame, fn: ReplyFunction) -> DataFrame:
    """Estimates per distinct ``cache_key``; ``missed`` has one row per key with the
    posting fields the prompt needs. Keys without an estimate are left out."""
    prompts = missed.select("cache_key", estimate_prompt().alias("prompt"))
    replies = ask(prompts, "cache_key", fn).drop("error")
    return parse_estimates(replies).filter("salary_display IS NOT NULL")
