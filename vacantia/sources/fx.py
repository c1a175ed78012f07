"""Exchange rates to INR from a landed rates payload."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vacantia import params as P
from vacantia.params import Params

FX_SCHEMA = "rates MAP<STRING,DOUBLE>, time_last_update_utc STRING"
CURRENCIES = ("INR", "USD", "EUR", "GBP")


def parse_fx(payloads: DataFrame, text: str = "value") -> DataFrame:
    """Add struct ``fx`` (rates, time_last_update_utc); NULL rates if unreadable."""
    return payloads.withColumn("fx", F.from_json(text, FX_SCHEMA))


def cross_rates(fx: Column, params: Params = Params()) -> tuple[dict[str, Column], Column]:
    """({currency: rate}, label). If any needed rate is missing or zero, the whole
    static table is used instead, and the label says so."""
    inr, eur, gbp = (F.try_element_at(fx["rates"], F.lit(c)) for c in ("INR", "EUR", "GBP"))
    live = inr.isNotNull() & (eur != 0) & (gbp != 0)
    live = F.coalesce(live, F.lit(False))
    computed = {"INR": F.lit(1.0), "USD": inr, "EUR": F.try_divide(inr, eur), "GBP": F.try_divide(inr, gbp)}
    static = {c: F.lit(params.fallback_fx.get(c)).cast("double") for c in CURRENCIES} | {"INR": F.lit(1.0)}
    rates = {c: F.when(live, computed[c]).otherwise(static[c]) for c in CURRENCIES}
    stamp = F.coalesce(fx["time_last_update_utc"], F.lit("unknown time"))
    label = F.when(live, F.concat(F.lit("live FX as of "), stamp)).otherwise(P.FALLBACK_FX_LABEL)
    return rates, label


def fx_table(payloads: DataFrame, params: Params = Params(), order: tuple[str, ...] = ()) -> DataFrame:
    """(currency, rate_to_inr, label), one row per currency whatever has landed.

    Of several payloads the last one in ``order`` that has all rates counts; if there
    is none, the static table does.
    """
    rates, label = cross_rates(F.col("fx"), params)
    table = lambda of: F.array(*[F.struct(F.lit(c).alias("currency"), of[c].alias("rate_to_inr")) for c in CURRENCIES])
    static = {c: F.lit(params.fallback_fx.get(c)).cast("double") for c in CURRENCIES} | {"INR": F.lit(1.0)}
    usable = payloads.withColumn("_label", label).filter(F.col("_label") != P.FALLBACK_FX_LABEL)
    rank = F.struct(*order) if order else F.lit(1)
    newest = usable.agg(F.max_by(F.struct(table(rates).alias("rates"), F.col("_label").alias("label")), rank).alias("t"))
    one = newest.select(
        F.coalesce("t.rates", table(static)).alias("rates"), F.coalesce("t.label", F.lit(P.FALLBACK_FX_LABEL)).alias("label"))
    return one.select(F.explode("rates").alias("r"), "label").select("r.*", "label").filter("rate_to_inr IS NOT NULL")


def read_fx(spark: SparkSession, path: str | None, params: Params = Params()) -> DataFrame:
    """Rates of the newest usable payload at ``path`` (a file or a folder); else the static table."""
    none = spark.createDataFrame([], "value string, at timestamp, file string")
    payloads = none
    if path is not None:
        try:
            payloads = spark.read.option("wholetext", True).text(path).select(
                "value", F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return fx_table(parse_fx(payloads), params, ("at", "file"))
