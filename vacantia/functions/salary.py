"""Reading stated pay ranges out of text, and printing them."""
from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from vacantia import params as P
from vacantia.functions.text import spaced, text_or_empty

LAKH = 100_000.0


def _amount(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def _guarded(only_if: Column | None, value: Column) -> Column:
    return value if only_if is None else F.when(only_if, value)


def with_lpa(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add struct(currency='LPA', low, high) of the first "a-b LPA"; NULL if absent or unreadable."""
    pattern = "(?iU)" + spaced(P.LPA_SPAN)
    cue = F.contains(F.lower(F.col(text)), F.lit("lpa"))
    piece = df.withColumn("_piece", F.when(cue, F.regexp_extract(text, pattern, 0)))
    read = piece.select(
        *[f"`{c}`" for c in df.columns],
        *[F.regexp_extract("_piece", pattern, g).try_cast("double").alias(n) for g, n in ((1, "_low"), (2, "_high"))],
    )
    value = F.struct(F.lit("LPA").alias("currency"), F.col("_low").alias("low"), F.col("_high").alias("high"))
    return read.select(
        *[f"`{c}`" for c in df.columns],
        F.when(F.col("_low").isNotNull() & F.col("_high").isNotNull(), value).alias(out),
    )


def with_range(df: DataFrame, text: str, out: str, only_if: Column | None = None) -> DataFrame:
    """Add struct(currency, low, high) of the first currency range.

    A ``k`` counts only after the upper amount and then scales both. Only the first
    range is looked at: if its numbers are unreadable the result is NULL. The pattern
    runs once over texts that hold a currency sign at all; its groups are then read
    from the short matched piece.
    """
    pattern = "(?U)" + spaced(P.MONEY_SPAN)
    kept = [f"`{c}`" for c in df.columns]
    cue = reduce(lambda a, b: a | b, [F.contains(text, F.lit(sign)) for sign in P.MONEY_SIGNS])
    wanted = cue if only_if is None else only_if & cue
    piece = df.withColumn("_piece", F.when(wanted, F.regexp_extract(text, pattern, 0)))
    symbol, low, high, thousand = (F.regexp_extract("_piece", pattern, g) for g in (1, 2, 4, 5))
    known = F.create_map(*[F.lit(x) for pair in P.SYMBOL_CURRENCY.items() for x in pair])
    read = piece.select(
        *kept, F.try_element_at(known, F.rtrim(F.lower(symbol), F.lit("."))).alias("_currency"),
        _amount(low).alias("_low"), _amount(high).alias("_high"),
        F.when(thousand != "", 1000.0).otherwise(1.0).alias("_scale"),
    )
    value = F.struct(
        F.col("_currency").alias("currency"), (F.col("_low") * F.col("_scale")).alias("low"),
        (F.col("_high") * F.col("_scale")).alias("high"),
    )
    readable = F.col("_low").isNotNull() & F.col("_high").isNotNull()
    return read.select(*kept, F.when(readable, value).alias(out))


def with_salary(df: DataFrame, source: str, out: str, only_if: Column | None = None) -> DataFrame:
    """LPA wording first, then a currency range."""
    texts = df.withColumn("_text", _guarded(only_if, text_or_empty(F.col(source))))
    lakhs = with_lpa(texts, "_text", "_lpa")
    both = with_range(lakhs, "_text", "_money", F.col("_lpa").isNull())
    return both.withColumn(out, F.coalesce("_lpa", "_money")).drop("_text", "_lpa", "_money")


def rate_for(currency: Column, joined_rate: Column) -> Column:
    """INR per unit: a lakh for LPA amounts, otherwise the joined exchange rate."""
    return F.when(currency == "LPA", LAKH).otherwise(joined_rate)


@F.pandas_udf(T.StringType())
def _format_span(style: pd.Series, currency: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    # C-style %g and half-even %.1f, which the JVM formatter does not offer
    def one(s, c, a, b):
        if s is None:
            return None
        if s == "stated":
            return f"₹{a:g}-{b:g} LPA, stated"
        if s == "converted":
            return f"₹{a:.1f}-{b:.1f} LPA, stated (converted from {c})"
        return f"Est. ₹{a:g}-{b:g} LPA"

    return pd.Series([one(*row) for row in zip(style, currency, low, high)], dtype="object")


def format_span(style: Column, currency: Column, low_lakh: Column, high_lakh: Column) -> Column:
    """Display text of a pay range in lakhs; style is ``stated``, ``converted`` or ``estimated``.

    Whole bounds below a million print as they are and stay on the JVM side; only the
    other rows show Python anything but NULLs.
    """
    whole = lambda x: (x >= 0) & (x < 1_000_000) & (x == F.floor(x))
    plain = F.coalesce(style.isin("stated", "estimated") & whole(low_lakh) & whole(high_lakh), F.lit(False))
    span = F.concat(F.lit("₹"), low_lakh.cast("long").cast("string"), F.lit("-"), high_lakh.cast("long").cast("string"), F.lit(" LPA"))
    shown = F.when(style == "stated", F.concat(span, F.lit(", stated"))).otherwise(F.concat(F.lit("Est. "), span))
    rest = _format_span(*[F.when(~plain, x) for x in (style, currency, low_lakh, high_lakh)])
    return F.when(plain, shown).otherwise(rest)


def stated_note(currency: Column) -> Column:
    return F.when(currency == "LPA", "stated in JD").otherwise(
        F.concat(F.lit("stated in JD as "), currency, F.lit(", converted to INR"))
    )
