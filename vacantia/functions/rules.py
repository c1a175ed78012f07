"""The rule scorer as column expressions: one narrow projection, no shuffle.

Work is staged in three selects. ``lowered`` columns are produced once and used
by many expressions, so Catalyst keeps them in their own projection instead of
inlining ``lower(description)`` dozens of times. The costly phrase counts sit
behind the cheap gates, as a row that already failed never needs them.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia import params as P
from vacantia.functions.text import (
    computed_once, contains_any, filled, first_phrase, first_word, phrase_hits, quoted, spaced, text_or_empty,
)
from vacantia.params import Params

_NUMBER = r"(\d+)"


def employment_reason(employment: Column, params: Params) -> Column:
    excluded = [t.lower() for t in params.excluded_employment]
    hit = (employment != "") & F.lower(employment).isin(excluded)
    return F.when(hit, F.concat(F.lit("employment_type="), quoted(employment), F.lit(" is excluded")))


def keyword_reason(lowered: Column, params: Params) -> Column:
    """``lowered``: lower-cased "title description"."""
    return first_word(lowered, params.excluded_words, "JD contains excluded keyword {!r}".format)


def hard_filter_reason(title: Column, description: Column, employment: Column, params: Params) -> Column:
    lowered = F.lower(F.concat_ws(" ", text_or_empty(title), text_or_empty(description)))
    return F.coalesce(employment_reason(employment, params), keyword_reason(lowered, params))


def role_text(title: Column, description: Column, params: Params = Params()) -> Column:
    """Title and description (or its opening), lower-cased: where a role is named."""
    opening = text_or_empty(description)
    if params.role_text_chars is not None:
        opening = F.substring(opening, 1, params.role_text_chars)
    return F.lower(F.concat_ws(" ", text_or_empty(title), opening))


def is_product_role(role_words: Column, params: Params) -> Column:
    """``role_words``: the column of :func:`role_text`."""
    return contains_any(role_words, params.role_titles + P.ALWAYS_ROLE_TITLES)


def marketing_hits(lowered_description: Column, params: Params) -> Column:
    return phrase_hits(lowered_description, P.MARKETING_WORDS + params.dominant_themes)


def product_hits(lowered_description: Column) -> Column:
    return phrase_hits(lowered_description, P.PRODUCT_WORDS)


def marketing_reason(marketing: Column, product: Column) -> Column:
    text = filled(P.MARKETING_TEXT, marketing.cast("string"), product.cast("string"))
    return F.when((marketing >= P.MARKETING_MIN_HITS) & (marketing > product), text)


def with_years(df: DataFrame, out: str = "years", only_if: Column | None = None) -> DataFrame:
    """Add struct(lo, hi): the years of experience the description asks for, NULL if none.

    Each pattern runs at most once over the text and only where the earlier ones found
    nothing; the numbers are read from the short piece that matched.
    """
    text = text_or_empty(F.col("description"))
    cue = F.contains(F.lower(text), F.lit("year")) if only_if is None else only_if

    def find(pattern: str) -> Column:
        return F.regexp_extract(text, "(?iU)" + spaced(pattern), 0)

    def number(piece: str, nth: int) -> Column:
        found = F.regexp_extract_all(piece, F.lit("(?U)" + _NUMBER), F.lit(1))
        return F.try_element_at(found, F.lit(nth)).try_cast("int")

    pieces = (
        df.withColumn("_span", F.when(cue, find(P.YEARS_SPAN)))
        .withColumn("_from", F.when(F.col("_span") == "", find(P.YEARS_FROM)))
        .withColumn("_least", F.when(F.col("_from") == "", find(P.YEARS_AT_LEAST)))
    )
    numbers = pieces.withColumn("_one", F.coalesce(
        *[F.when(F.col(piece) != "", number(piece, 1)) for piece in ("_span", "_from", "_least")]
    )).withColumn("_two", F.when(F.col("_span") != "", number("_span", 2)).otherwise(F.lit(99)))
    years = F.struct(F.least("_one", "_two").alias("lo"), F.greatest("_one", "_two").alias("hi"))
    return numbers.select(*[f"`{c}`" for c in df.columns], F.when(F.col("_one").isNotNull(), years).alias(out))


def seniority_of(title: Column, years: Column, params: Params) -> Column:
    """``years``: the column of :func:`with_years`."""
    senior_title = F.rlike(text_or_empty(title), F.lit("(?iU)" + P.SENIOR_TITLE))
    return (
        F.when(senior_title, "senior")
        .when(years.isNull(), "unclear")
        .when(years["hi"] < params.floor_years, "junior")
        .when(years["lo"] >= params.ceiling_years, "senior")
        .otherwise("fits")
    )


def seniority_reason(seniority: Column, prefix: str = "heuristic ") -> Column:
    text = filled(prefix + P.SENIORITY_TEXT, seniority)
    return F.when(seniority.isin("junior", "senior"), text)


def location_tier(location: Column, remote_type: Column, params: Params) -> Column:
    """1 remote, 2 domestic, 3 international; region words are tested before the home country."""
    lowered = F.lower(text_or_empty(location))
    return (
        F.when(remote_type == "remote", 1)
        .when(contains_any(lowered, params.domestic_cities), 2)
        .when(contains_any(lowered, params.international_regions), 3)
        .when(F.contains(lowered, F.lit(P.HOME_COUNTRY_WORD)), 2)
        .otherwise(3)
    )


def employer_type(prioritised_hits: Column, deprioritised_hits: Column) -> Column:
    service = (deprioritised_hits > 0) & (deprioritised_hits > prioritised_hits)
    return F.when(service, "service").otherwise("product")


def sponsorship(lowered_description: Column, params: Params) -> Column:
    """struct(confidence, evidence) from explicit phrases only."""
    phrase = first_phrase(lowered_description, params.confirmed_phrases)
    return F.struct(
        F.when(phrase.isNotNull(), "confirmed").otherwise("unconfirmed").alias("confidence"),
        phrase.alias("evidence"),
    )


def sponsorship_reason(tier: Column, confidence: Column, params: Params, prefix: str = "heuristic: ") -> Column:
    rank = F.lit(0)
    for name, value in P.CONFIDENCE_RANK.items():
        rank = F.when(confidence == name, value).otherwise(rank)
    needed = P.CONFIDENCE_RANK.get(params.min_confidence, 1)
    text = filled(prefix + P.SPONSORSHIP_TEXT, quoted(confidence), quoted(F.lit(params.min_confidence)))
    return F.when((tier == 3) & (rank < needed), text)


def raw_score(hits: Column, seniority: Column, title: Column) -> Column:
    points = (
        F.lit(30)
        + F.least(hits, F.lit(8)) * 5
        + F.when(seniority == "fits", 20).otherwise(10)
        + F.when(F.contains(F.lower(text_or_empty(title)), F.lit("technical")), 10).otherwise(0)
    )
    return F.least(points, F.lit(100)).cast("int")


def employer_penalty(score: Column, employer: Column, params: Params) -> Column:
    """Service companies lose points; the result stays within 0..100."""
    weighted = score - F.when(employer == "service", params.service_penalty).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), weighted)).cast("int")


def match_reason(hits: Column, seniority: Column, employer: Column) -> Column:
    return filled(P.MATCH_TEXT, hits.cast("string"), seniority, employer)


def score_postings(postings: DataFrame, params: Params = Params()) -> DataFrame:
    """All input columns plus the match columns of the rule scorer (map-only)."""
    c = F.col
    kept = [c(f"`{name}`") for name in postings.columns]

    lowered = postings.select(
        *kept,
        F.lower(text_or_empty(c("description"))).alias("_text"),
        F.lower(F.concat_ws(" ", text_or_empty(c("title")), text_or_empty(c("description")))).alias("_both"),
        role_text(c("title"), c("description"), params).alias("_opening"),
    )
    early = lowered.select(
        *kept, "_text",
        F.coalesce(
            employment_reason(c("employment_type"), params),
            keyword_reason(c("_both"), params),
            F.when(~is_product_role(c("_opening"), params), F.lit(P.REASON_ROLE)),
        ).alias("_early"),
    )
    open_ = c("_early").isNull()
    dated = with_years(early, "_years", open_ & F.contains(c("_text"), F.lit("year")))
    counted = dated.select(
        *kept, "_text", "_early", "_years",
        F.when(open_, marketing_hits(c("_text"), params)).alias("_marketing"),
        F.when(open_, product_hits(c("_text"))).alias("_product"),
        F.when(open_, phrase_hits(c("_text"), params.prioritised)).alias("_prioritised"),
        F.when(open_, phrase_hits(c("_text"), params.deprioritised)).alias("_deprioritised"),
        F.when(open_, phrase_hits(c("_text"), params.search_words)).alias("_search"),
        location_tier(c("location"), c("remote_type"), params).alias("_tier"),
    )
    judged = counted.select(
        *kept, "_tier", (c("_search") + c("_prioritised")).alias("_hits"),
        F.coalesce(c("_early"), marketing_reason(c("_marketing"), c("_product"))).alias("_early"),
        seniority_of(c("title"), c("_years"), params).alias("_seniority"),
        employer_type(c("_prioritised"), c("_deprioritised")).alias("_employer"),
        F.when(open_ & (c("_tier") == 3), sponsorship(c("_text"), params)).alias("_sponsor"),
    )
    gated = judged.select(
        *kept, "_tier", "_hits", "_seniority", "_employer", "_sponsor",
        F.coalesce(c("_early"), seniority_reason(c("_seniority"))).alias("_early"),
    ).select(
        "*",
        F.when(c("_early").isNull(), sponsorship_reason(c("_tier"), c("_sponsor.confidence"), params)).alias("_late"),
        raw_score(c("_hits"), c("_seniority"), c("title")).alias("_raw"),
    )
    # a row stopped by an early gate has no tier, employer or sponsorship values;
    # one stopped by the sponsorship gate keeps them
    reached = c("_early").isNull()
    passed = reached & c("_late").isNull()
    return gated.select(
        *kept,
        F.when(passed, employer_penalty(c("_raw"), c("_employer"), params)).alias("role_fit_score"),
        F.when(passed, c("_raw")).alias("raw_role_fit_score"),
        F.when(passed, match_reason(c("_hits"), c("_seniority"), c("_employer"))).otherwise("").alias("match_reason"),
        F.when(reached, c("_tier")).alias("location_tier"),
        F.when(reached, c("_employer")).alias("employer_type"),
        F.when(reached, c("_sponsor.confidence")).alias("sponsorship_confidence"),
        F.when(reached, c("_sponsor.evidence")).alias("sponsorship_evidence"),
        computed_once(~passed).alias("hard_filtered"),
        F.coalesce(c("_early"), c("_late")).alias("hard_filter_reason"),
    )
