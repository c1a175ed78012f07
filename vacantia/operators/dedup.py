"""Deduplication, caps and paging over feed rows.

``order`` is always a list of columns that orders rows uniquely within a group.
"""
from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from vacantia.functions.text import url_key
from vacantia.schema import REFRESHED


#: Bits of the types a position can be packed from; a timestamp's microseconds up to the year 9999 take 60.
_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64, "date": 32, "timestamp": 60, "timestamp_ntz": 60}
_MOST = 10**38  # what a 38-digit decimal can hold


def _position(order: Sequence[str]) -> Column:
    """The order columns as a value of the output."""
    return F.struct(*order) if len(order) > 1 else F.col(order[0])


def _whole(name: str, kind: str) -> Column:
    """A date or time as a whole number, whatever the session time zone."""
    c = F.col(name)
    if kind == "date":
        return F.unix_date(c)
    if kind == "timestamp":
        return F.unix_micros(c)
    if kind == "timestamp_ntz":
        micros = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
        return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + (F.hour(c) * 60 + F.minute(c)).cast("long") * 60_000_000 + micros
    return c


def packed_position(df: DataFrame, order: Sequence[str]) -> Column:
    """One value that orders rows as the ``order`` columns do, NULL before all others.

    Whole numbers, dates and times are packed into one number, which a hash aggregation can hold in
    place; anything else (a file name) or too much of it stays a struct.
    """
    kinds = dict(df.dtypes)
    widths = [2 ** _BITS.get(kinds[name], 200) + 1 for name in order]
    total = reduce(lambda a, b: a * b, widths)
    if total > _MOST:
        return F.struct(*order)
    if len(order) == 1:
        return F.coalesce(_whole(order[0], kinds[order[0]]).cast("long"), F.lit(-(2**63)))
    exact = lambda n: F.lit(Decimal(n)).cast("decimal(38,0)")
    number = exact(0)
    for name, width in zip(order, widths):
        above = _whole(name, kinds[name]).cast("decimal(38,0)") + exact((width + 1) // 2)  # 1 for the lowest value
        number = (number * exact(width) + F.coalesce(above, exact(0))).cast("decimal(38,0)")
    return number.cast("long") if total < 2**63 else number


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Inner join on equal values (NULL equals NULL); of the columns only the left ones stay.

    The right side is narrow, with a row for a left row at most, so its hash table is a small part of what
    the task reads of the left side, which is streamed and never sorted.
    """
    renamed = right.withColumnsRenamed({name: f"_r{name}" for name in columns}).hint("shuffle_hash")
    on = reduce(lambda a, b: a & b, [F.col(name).eqNullSafe(F.col(f"_r{name}")) for name in columns])
    return left.join(renamed, on).drop(*[f"_r{name}" for name in columns])


def distinct_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first. ``order`` has to be unique within a key.

    Narrow first: the position of the first row of a key is a hash aggregation of (key, number), whose
    partial step leaves one row per key and task; the rows themselves are met by (key, position), so that
    a hot key's rows spread over all tasks and no text is sorted.
    """
    placed = df.withColumn("_at", packed_position(df, order))
    ends = placed.groupBy(*keys).agg(F.min("_at").alias("_at"))
    return _same(placed, ends, [*keys, "_at"]).select(*df.columns)


def distinct_last(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per non-blank key: the last, with ``first_pos`` = position of the first. As :func:`distinct_first`."""
    placed = df.filter(F.col(key) != "").withColumn("_at", packed_position(df, order))
    ends = placed.groupBy(key).agg(F.max("_at").alias("_at"), F.min("_at").alias("_first"))
    last = _same(placed, ends, [key, "_at"])
    first = placed.select(key, F.col("_at").alias("_first"), _position(order).alias("first_pos"))
    return _same(last, _same(first, ends.select(key, "_first"), [key, "_first"]), [key, "_first"]).select(*df.columns, "first_pos")


def cap_per_group(df: DataFrame, cap: int | None, group: str, order: Sequence[str]) -> DataFrame:
    """The first ``cap`` rows per group; all rows without a cap. Each task keeps at most ``cap`` rows per
    group before the shuffle (Spark plans a window group limit), so a hot group is harmless."""
    if cap is None:
        return df
    rank = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(rank)).filter(F.col("_rn") <= cap).drop("_rn")


def page_cutoff(pages: DataFrame, run: str, max_pages: int | None) -> DataFrame:
    """Pages a client would have read: pages 1.., stop before an empty page, stop
    after ``last_page``, and, if that is given, never beyond ``max_pages``.

    ``pages``: one row per (run, page) with ``n_jobs`` and nullable ``last_page``.
    """
    inside = pages.filter(F.col("page") >= 1 if max_pages is None else F.col("page").between(1, max_pages))
    stops = inside.groupBy(run).agg(
        F.min(F.when(F.col("n_jobs") == 0, F.col("page"))).alias("_empty"),
        F.min(F.when((F.col("last_page") != 0) & (F.col("page") >= F.col("last_page")), F.col("page"))).alias("_last"),
    )
    read = F.coalesce(F.col("page") < F.col("_empty"), F.lit(True)) & F.coalesce(F.col("page") <= F.col("_last"), F.lit(True))
    return inside.join(stops, run).filter(read).drop("_empty", "_last")


def cap_by_round(
    df: DataFrame, cap: int | None, group: str, url: str, round_: str, pos: str, keep: str = "first",
) -> DataFrame:
    """Keyword searches in rounds: stop after the round in which the distinct URLs
    reach ``cap``; dedup by URL among the rounds read (first or last record wins,
    the position is always the first one's); keep the first ``cap`` URLs.

    The stop is the first round of the cap-th distinct URL, so a group limit over
    (group, URL, first position) gives the URLs to keep and the stop at once; each task
    keeps ``cap`` rows per group before the shuffle. Only narrow columns are shuffled
    until the winners meet their rows again.
    """
    narrow = df.select(group, url, round_, pos)
    if keep == "last":
        narrow = narrow.filter(F.col(url) != "")
    at = F.struct(F.col(round_).alias("r"), F.col(pos).alias("p"))
    first = narrow.groupBy(group, url).agg(F.min(at).alias("_first"))
    kept = first
    if cap is not None:
        rank = Window.partitionBy(group).orderBy("_first")
        limited = first.withColumn("_rn", F.row_number().over(rank)).filter(F.col("_rn") <= cap)
        # at most cap rows per group are left; the cap-th one stops the reading
        stop = F.max(F.when(F.col("_rn") == cap, F.col("_first.r"))).over(Window.partitionBy(group))
        kept = limited.withColumn("_stop", stop).drop("_rn")
    else:
        kept = first.withColumn("_stop", F.lit(None).cast("int"))
    if keep == "first":
        chosen = kept.select(group, url, "_first", F.col("_first").alias("_chosen"))
    else:
        read = narrow.join(kept, [group, url]).filter(F.col("_stop").isNull() | (F.col(round_) <= F.col("_stop")))
        chosen = read.groupBy(group, url).agg(F.first("_first").alias("_first"), F.max(at).alias("_chosen"))
    winners = chosen.select(
        F.col(group).alias("_g"), F.col("_chosen.r").alias("_r"), F.col("_chosen.p").alias("_p"),
        F.col(url).alias("_u"), F.struct("_first.r", "_first.p").alias("first_pos"),
    )
    same = (
        (F.col(group) == F.col("_g")) & (F.col(url) == F.col("_u"))
        & (F.col(round_) == F.col("_r")) & (F.col(pos) == F.col("_p"))
    )
    return df.join(winners, same).drop("_g", "_r", "_p", "_u")


def with_key(postings: DataFrame) -> DataFrame:
    return postings.withColumn("url_hash", url_key(F.col("url")))


def collapse_batch(sightings: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sightings of one batch -> one row per ``url_hash``. ``order`` has to be unique within a key.

    url and source come from the first sighting, every refreshed field from the last. Narrow first: both
    ends and the count are one hash aggregation of (key, number), whose partial step leaves one row per key
    and task; the texts are then met by (key, position). A key with a third of all rows spreads over all
    tasks there, texts are never sorted, and only the last sighting's texts go on.
    """
    at = _position(order)
    placed = sightings.withColumn("_at", packed_position(sightings, order))
    ends = placed.groupBy("url_hash").agg(
        F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count(F.lit(1)).alias("sightings"))
    first = _same(
        placed.select("url_hash", "_at", "url", "source", at.alias("first_pos")),
        ends.select("url_hash", F.col("_first").alias("_at")), ["url_hash", "_at"]).drop("_at")
    last = _same(
        placed.select("url_hash", "_at", *REFRESHED, at.alias("last_pos")),
        ends.select("url_hash", F.col("_last").alias("_at"), "sightings"), ["url_hash", "_at"]).drop("_at")
    return last.join(first.hint("shuffle_hash"), "url_hash").select(
        "url_hash", "url", "source", *REFRESHED, "last_pos", "first_pos", "sightings")
