"""Salary cascade: stated -> valid cache -> estimate -> not disclosed."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia import params as P
from vacantia.functions.salary import LAKH, format_span, rate_for, stated_note, with_salary
from vacantia.functions.text import cache_key, computed_once
from vacantia.operators.plugins import ReplyFunction, estimate
from vacantia.params import Params
from vacantia.sources.fx import CURRENCIES


def with_stated(rows: DataFrame, fx: DataFrame) -> DataFrame:
    """Add struct ``stated`` (currency, salary_min_inr, salary_max_inr): salary_text first, then the description.

    The rates (one per currency of ``fx``, four at most) are read once and become a literal
    map, so rows never meet a join. An amount in a currency without a rate counts as not stated.
    """
    table = fx.filter(F.col("currency").isin(*CURRENCIES)).groupBy("currency").agg(F.max("rate_to_inr").alias("rate")).collect()
    pairs = [F.lit(x) for r in table if r["rate"] is not None for x in (r["currency"], float(r["rate"]))]
    rates = F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,double>")

    def priced(df: DataFrame, source: str, out: str, only_if: Column | None = None) -> DataFrame:
        found = with_salary(df, source, "_s", only_if)
        rate = rate_for(F.col("_s.currency"), F.try_element_at(rates, F.col("_s.currency")))
        value = F.struct(
            F.col("_s.currency").alias("currency"),
            (F.col("_s.low") * rate).alias("salary_min_inr"),
            (F.col("_s.high") * rate).alias("salary_max_inr"),
        )
        return found.withColumn(out, F.when(rate.isNotNull(), value)).drop("_s")

    first = priced(rows, "salary_text", "_in_field")
    both = priced(first, "description", "_in_text", F.col("_in_field").isNull())
    return both.withColumn("stated", computed_once(F.coalesce("_in_field", "_in_text"))).drop("_in_field", "_in_text")


def stated_display(stated: Column) -> Column:
    lpa = stated["currency"] == "LPA"
    return format_span(
        F.when(lpa, "stated").when(stated.isNotNull(), "converted"), stated["currency"],
        stated["salary_min_inr"] / LAKH, stated["salary_max_inr"] / LAKH,
    )


def ttl_lookup(keys: DataFrame, cache: DataFrame, now: Column, days: int) -> DataFrame:
    """Cache rows for the given keys that are still valid.

    An age counts in whole days, rounded down, so an entry lives until just before
    ``days + 1`` days; entries from the future are valid. Written as a range test on
    the plain column, the check is pushed into the cache scan.
    """
    valid = cache.filter(F.col("looked_up_at") > now - F.make_dt_interval(F.lit(days + 1)))
    return keys.join(valid, "cache_key", "left")


def price_base(rows: DataFrame, fx: DataFrame) -> DataFrame:
    """Rows with their ``stated`` salary and their ``cache_key``."""
    key = cache_key(F.col("company"), F.col("title"), F.col("location"))
    return with_stated(rows, fx).withColumn("cache_key", key)


def settle_keys(
    base: DataFrame, cache: DataFrame, now: Column, params: Params = Params(),
    fn: ReplyFunction | None = None, ord_: str = "ord",
) -> DataFrame:
    """One row per cache key that some row without a stated salary needs.

    ``hit``: a valid cache row exists; otherwise the key was looked up now (by ``fn``,
    if given, once per key) and ``first_ord`` is the row that caused it.
    """
    asked = F.struct("title", "company", "location", "remote_type")
    keys = base.filter("stated IS NULL").groupBy("cache_key").agg(
        F.min(ord_).alias("first_ord"), *([F.min_by(asked, ord_).alias("_asked")] if fn else []),
    )
    known = ttl_lookup(keys, cache, now, params.cache_ttl_days)
    guess_type = "struct<salary_display:string,salary_min_inr:double,salary_max_inr:double,source_note:string>"
    if fn:
        guesses = estimate(known.filter("looked_up_at IS NULL").select("cache_key", "_asked.*"), fn).select(
            "cache_key", F.struct("salary_display", "salary_min_inr", "salary_max_inr", "source_note").alias("g")
        )
        known = known.join(guesses, "cache_key", "left")
    else:
        known = known.withColumn("g", F.lit(None).cast(guess_type))
    hit = F.col("looked_up_at").isNotNull()
    display = F.when(hit, F.col("salary_display")).otherwise(F.coalesce("g.salary_display", F.lit(P.NOT_DISCLOSED)))
    return known.select(
        "cache_key", "first_ord", hit.alias("hit"), display.alias("salary_display"),
        *[F.when(hit, F.col(c)).otherwise(F.col(f"g.{c}")).alias(c) for c in ("salary_min_inr", "salary_max_inr")],
        F.col("g.source_note").alias("source_note"),
        (~hit & F.col("g").isNotNull()).alias("estimated"),
    )


def priced_rows(base: DataFrame, settled: DataFrame, ord_: str = "ord") -> DataFrame:
    """Salary columns for every row.

    The first row of a looked-up key carries the estimate itself, every later one
    reuses it as "cached estimate". Posting rows meet their key in one join with a
    unique right side, whose hot keys AQE can split.
    """
    found = base.filter("stated IS NULL").select("url_hash", ord_, "cache_key").join(settled, "cache_key")
    reused = F.col("hit") | (F.col(ord_) > F.col("first_ord"))
    looked_up = found.select(
        "url_hash", ord_, "salary_display", "salary_min_inr", "salary_max_inr",
        F.when(reused, F.contains("salary_display", F.lit("Est."))).otherwise(F.col("estimated")).alias("is_estimated"),
        F.when(reused, P.CACHED_NOTE).otherwise(F.col("source_note")).alias("source_note"),
    )
    stated = base.filter("stated IS NOT NULL").select(
        "url_hash", ord_, stated_display(F.col("stated")).alias("salary_display"),
        "stated.salary_min_inr", "stated.salary_max_inr", F.lit(False).alias("is_estimated"),
        stated_note(F.col("stated.currency")).alias("source_note"),
    )
    return stated.unionByName(looked_up)


def cache_rows(settled: DataFrame, now: Column) -> DataFrame:
    """Cache rows to write: every key looked up in this run, found or not."""
    return settled.filter("NOT hit").select(
        "cache_key", "salary_display", "salary_min_inr", "salary_max_inr", now.alias("looked_up_at")
    )
