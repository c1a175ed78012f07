"""Incremental ingest: newly landed feed files go through the batch jobs once each."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from vacantia.params import Params
from vacantia.plans.daily import ingest_and_score, ts
from vacantia.sources import feeds, registry, state as S


def apply_batch(
    spark: SparkSession, batch: DataFrame, order: list[str], state_root: str, now: str, params: Params = Params(),
    stream: str | None = None, batch_id: int | None = None, keep: int = 3,
) -> int:
    """Upsert and score one batch of canonical postings as a new generation.

    Only the buckets the batch touches are written, and the newest ``keep`` generations stay. A stream's
    batch is committed with its id: one that is delivered again writes nothing.
    """
    new = S.Generation(spark, state_root)
    if stream is not None and batch_id <= new.streams.get(stream, -1):
        return new.number - 1
    ingest_and_score(new, batch, order, ts(now), params)
    if stream is not None:
        new.streams[stream] = batch_id
    generation = new.commit(now)
    S.expire(spark, state_root, keep)
    return generation


def _drained(stream: DataFrame, handle, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def start_ingest(
    spark: SparkSession, stream: DataFrame, order: list[str], state_root: str, checkpoint: str, now: str,
    params: Params = Params(),
) -> StreamingQuery:
    """Drain a stream of canonical postings, then stop. The checkpoint records what was read."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch.sparkSession, batch, order, state_root, now, params, checkpoint, batch_id)

    return _drained(stream, handle, checkpoint)


def start_feed(
    spark: SparkSession, feed: str, path: str, state_root: str, rejects: str, checkpoint: str, now: str,
    params: Params = Params(), pages: DataFrame | None = None,
) -> StreamingQuery:
    """Drain everything that has landed in a feed's folder, JSON or RSS, then stop.

    One query per folder: a micro-batch is read and parsed once, into a written table. Its postings are
    de-duplicated and cut as a batch run does it and go into the state; what can't be used goes to
    ``<rejects>/batch=<id>``, which a batch delivered again replaces by the same rows.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        rows = registry.staged(feeds.parsed(batch, feed, params))
        registry.rejects_of(rows, feed).write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        listing = registry.read_pages(batch) if params.max_pages is not None and feed == "arbeitnow" else None
        found = registry.settled(rows, feed, params, pages, listing)
        apply_batch(session, found, list(registry.ARRIVAL), state_root, now, params, checkpoint, batch_id)

    return _drained(feeds.read_landed(spark, feed, path, streaming=True), handle, checkpoint)


def read_rejects(spark: SparkSession, rejects: str) -> DataFrame:
    """(source, file, pos, error, batch) of a feed's folder."""
    return spark.read.schema(f"{registry.REJECTS}, batch long").option("basePath", rejects).parquet(rejects).select(
        "source", "file", "pos", "error", F.col("batch").cast("long"))
