"""One run: sightings -> state -> scores -> salaries -> report.

Each stage reads tables and writes the next ones of a new generation; what feeds two
others is written once and read back, which also cuts the lineage. The generation
becomes current only when everything is written. Texts are read and written once, and
only in the buckets the batch touches; every later step works on keys, status, matches
and salaries and reads the texts of the postings it asks for.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vacantia import params as P
from vacantia.operators import enrich, plugins, ranking, upsert
from vacantia.operators.dedup import collapse_batch, with_key
from vacantia.operators.verdicts import match_totals
from vacantia.params import Params
from vacantia.schema import MATCHES
from vacantia.sources import state as S
from vacantia.sources.feeds import valid
from vacantia.sources.report_files import write_report


@dataclass(frozen=True)
class RunResult:
    generation: int
    report_path: str | None
    totals: dict[str, int]


def ts(now: str) -> Column:
    """A UTC timestamp literal."""
    return F.to_timestamp_ntz(F.lit(now))


def score_queue(
    postings: DataFrame, matches: DataFrame, now: Column, params: Params, scorer: plugins.ReplyFunction | None = None,
) -> DataFrame:
    """Match rows for every posting that has none."""
    queue = upsert.match_queue(postings, matches)
    scored = plugins.score(queue, params, scorer)
    return scored.select(*[F.col(f.name) for f in MATCHES if f.name != "matched_at"], now.alias("matched_at"))


def stage(df: DataFrame, root: str, generation: int, name: str) -> DataFrame:
    """Write an intermediate table in a folder of the caller's and read it back."""
    path = f"{root}/generation={generation}/_staging/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert_batch(new: S.Generation, batch: DataFrame, order: Sequence[str], now: Column) -> DataFrame:
    """Bucket-wise upsert of a batch of sightings: (url_hash, is_new, sightings) of the keys it holds.

    Only buckets that hold a key of the batch are read, joined and written. Whether a key is
    new is read from the narrow status table.
    """
    # written once: the collapse reads the batch for its keys, its first and its last sightings
    landed = new.stage(with_key(valid(batch)), "landed")
    fresh = new.stage(collapse_batch(landed, order), "fresh")
    touched = new.buckets("postings", fresh)
    known = new.read("status", touched).select("url_hash", F.lit(False).alias("is_new"))
    seen = new.stage(fresh.select("url_hash", "sightings").join(known, "url_hash", "left").select(
        "url_hash", F.coalesce("is_new", F.lit(True)).alias("is_new"), "sightings"), "seen")
    new.write("postings", upsert.merged(new.read("postings", touched), fresh, now), touched)
    new.merge("status", seen.filter("is_new").select("url_hash", F.lit("new").alias("status")))
    return seen


def content(new: S.Snapshot, keys: DataFrame) -> DataFrame:
    """The postings (without status) of a written table of keys; other buckets aren't read."""
    held = new.buckets("postings", keys)
    return new.read("postings", held).join(keys.select("url_hash"), "url_hash", "left_semi")


@dataclass(frozen=True)
class Scored:
    """What ingest and scoring of a generation found; it is not committed yet."""

    seen: DataFrame          # (url_hash, is_new, sightings) of the batch
    queue: DataFrame         # keys that had no match row
    new_matches: DataFrame


def ingest_and_score(
    new: S.Generation, batch: DataFrame, order: Sequence[str], now: Column, params: Params,
    scorer: plugins.ReplyFunction | None = None,
) -> Scored:
    """Upsert a batch, score the queue, and move the status of what was scored."""
    matches = new.read("matches")
    seen = upsert_batch(new, batch, order, now)
    queue = new.stage(upsert.match_queue(new.read("status"), matches).select("url_hash"), "queue")
    new_matches = new.stage(score_queue(content(new, queue), matches, now, params, scorer), "new_matches")
    new.merge("matches", new_matches)
    status = new.read("status", new.buckets("status", new_matches))
    moved = upsert.status_on_match(status, new_matches).join(new_matches.select("url_hash"), "url_hash", "left_semi")
    new.merge("status", new.stage(moved, "moved"))
    return Scored(seen, queue, new_matches)


def reportable(new: S.Generation, name: str, params: Params) -> DataFrame:
    """Report rows of the generation so far, as a written table."""
    keys = new.stage(
        ranking.selected_matches(new.read("matches"), params).select("url_hash").join(
            new.read("status").filter(F.col("status").isin(*P.REPORTABLE_STATUSES)), "url_hash"), f"{name}_keys")
    state = {"postings": S.with_status(content(new, keys), keys), "matches": new.read("matches"), "salaries": new.read("salaries")}
    return new.stage(ranking.report_rows(state, params), name)


def run_daily(
    spark: SparkSession, batch: DataFrame, order: Sequence[str], fx: DataFrame, state_root: str, now: str,
    params: Params = Params(), report_root: str | None = None,
    scorer: plugins.ReplyFunction | None = None, estimator: plugins.ReplyFunction | None = None,
    keep: int = 3,
) -> RunResult:
    """Run all stages over a batch of canonical postings and commit the new state.

    Idempotent: the upsert is keyed, scored postings leave the queue, priced ones are
    not priced again, and the report always follows from the state. The newest ``keep``
    generations stay readable.
    """
    at = ts(now)
    new = S.Generation(spark, state_root)
    scored = ingest_and_score(new, batch, order, at, params, scorer)

    todo = ranking.needs_salary(reportable(new, "todo", params)).withColumn("ord", F.col("url_hash"))
    base = new.stage(enrich.price_base(todo, fx), "price_base")
    # written before use: an estimator must be asked once per key, not once per reader
    settled = new.stage(enrich.settle_keys(base, new.read("salary_lookup_cache"), at, params, estimator), "settled")
    new.merge("salaries", new.stage(enrich.priced_rows(base, settled).withColumn("enriched_at", at), "new_salaries"))
    new.merge("salary_lookup_cache", new.stage(enrich.cache_rows(settled, at), "new_cache"))

    report = reportable(new, "report", params)
    queued = report.select("url_hash", F.lit("queued_for_review").alias("status"))
    new.merge("status", new.stage(queued, "queued"))
    path = None
    if report_root is not None:
        first = fx.select("label").first()  # one text, the same in all rate rows
        label = first[0] if first else P.FALLBACK_FX_LABEL
        path = write_report(ranking.document(report, F.lit(label), at), report_root, now[:10])
    fresh, seen = upsert.dedup_totals(scored.seen).first()
    passed, asked = match_totals(scored.queue, scored.new_matches).first()
    generation = new.commit(now)
    S.expire(spark, state_root, keep)
    return RunResult(generation, path, {"new": fresh, "seen": seen, "passed": passed, "scored": asked})
