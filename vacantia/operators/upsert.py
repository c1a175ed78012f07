"""Keyed upserts over snapshots, the scoring queue, and posting status."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from vacantia import params as P
from vacantia.operators.dedup import collapse_batch, with_key
from vacantia.schema import POSTINGS, REFRESHED
from vacantia.sources.feeds import valid


def _merged(old: DataFrame, fresh: DataFrame, now: Column) -> tuple[DataFrame, dict[str, Column]]:
    """Old postings and collapsed sightings side by side, and the content of each posting after them.

    A known key keeps url, source and first_seen_at; the other content is refreshed. One full outer join
    on the (unique on both sides) key.
    """
    kept = [f.name for f in POSTINGS if f.name in old.columns and f.name != "url_hash"]
    both = old.select("url_hash", F.struct(*kept).alias("o")).join(fresh.withColumn("_seen", F.lit(True)), "url_hash", "full_outer")
    known, seen = F.col("o").isNotNull(), F.col("_seen").isNotNull()
    first = {"url": F.col("url"), "source": F.col("source"), "first_seen_at": now}
    values = {name: F.when(seen, F.col(name)).otherwise(F.col(f"o.{name}")) for name in REFRESHED}
    values |= {name: F.when(known, F.col(f"o.{name}")).otherwise(new) for name, new in first.items()}
    values |= {"url_hash": F.col("url_hash"), "last_seen_at": F.when(seen, now).otherwise(F.col("o.last_seen_at"))}
    return both, values


def merged(old: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """Postings without their status after a batch of collapsed sightings."""
    both, values = _merged(old, fresh, now)
    return both.select(*[values[f.name].alias(f.name) for f in POSTINGS if f.name != "status"])


def upsert_postings(state: DataFrame, batch: DataFrame, now: Column, order: Sequence[str]) -> DataFrame:
    """State after a batch of sightings, with ``is_new`` and ``sightings`` per touched key; a new key's status is new.

    For tables that aren't kept in buckets; a run merges by bucket (:func:`vacantia.plans.daily.upsert_batch`).
    """
    both, values = _merged(state, collapse_batch(with_key(valid(batch)), order), now)
    known, seen = F.col("o").isNotNull(), F.col("_seen").isNotNull()
    values["status"] = F.when(known, F.col("o.status")).otherwise("new")
    return both.select(
        *[values[f.name].alias(f.name) for f in POSTINGS],
        F.when(seen, ~known).alias("is_new"),
        F.coalesce("sightings", F.lit(0)).alias("sightings"),
    )


def dedup_totals(upserted: DataFrame) -> DataFrame:
    """New and already-seen sightings; a repeat inside the batch counts as seen."""
    new = F.coalesce(F.count_if(F.col("is_new")), F.lit(0))
    return upserted.agg(
        new.alias("new_count"), (F.coalesce(F.sum("sightings"), F.lit(0)) - new).alias("seen_count")
    )


def existing_keys(batch: DataFrame, state: DataFrame) -> DataFrame:
    """Distinct keys of a batch with ``is_new``; only the key column is read and shuffled."""
    keys = with_key(valid(batch)).select("url_hash").distinct()
    known = state.select("url_hash", F.lit(True).alias("_known"))
    return keys.join(known, "url_hash", "left").select("url_hash", F.col("_known").isNull().alias("is_new"))


def match_queue(postings: DataFrame, matches: DataFrame) -> DataFrame:
    """Postings without a match row yet, whatever run left them unscored."""
    return postings.join(matches.select("url_hash"), "url_hash", "left_anti")


def upsert_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or replace whole rows by key (``new`` holds each key once)."""
    untouched = old.join(new.select(key), key, "left_anti")
    return untouched.unionByName(new.select(*old.columns))


def status_on_match(postings: DataFrame, new_matches: DataFrame) -> DataFrame:
    """``new`` -> ``skipped``/``matched`` for rows scored now; other states stay. A (url_hash, status) table is enough."""
    scored = new_matches.select("url_hash", F.col("hard_filtered").alias("_filtered"))
    moved = F.when(F.col("_filtered"), "skipped").otherwise("matched")
    status = F.when((F.col("status") == "new") & F.col("_filtered").isNotNull(), moved).otherwise(F.col("status"))
    joined = postings.join(scored, "url_hash", "left")
    return joined.withColumn("status", status).select(*postings.columns)


def set_status(postings: DataFrame, changes: DataFrame) -> DataFrame:
    """Manual transitions ``(url_hash, status)``, each key once. Any state may follow
    any other; a value outside the status list fails the job with that value."""
    checked = changes.select(
        "url_hash",
        F.when(F.col("status").isin(*P.STATUSES), F.col("status"))
        .otherwise(F.raise_error(F.concat(F.lit("invalid status "), F.coalesce("status", F.lit("NULL")))))
        .alias("_status"),
    )
    joined = postings.join(checked, "url_hash", "left")
    return joined.withColumn("status", F.coalesce("_status", "status")).select(*postings.columns)


def mark_queued(postings: DataFrame, reported: DataFrame) -> DataFrame:
    """``queued_for_review`` for every reported key. A (url_hash, status) table is enough."""
    keys = reported.select("url_hash", F.lit(True).alias("_reported"))
    joined = postings.join(keys, "url_hash", "left")
    status = F.when(F.col("_reported"), "queued_for_review").otherwise(F.col("status"))
    return joined.withColumn("status", status).select(*postings.columns)
