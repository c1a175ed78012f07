"""Column functions of the Markdown report."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from vacantia import params as P
from vacantia.functions.text import or_default, text_or_empty


def run_date(at: Column) -> Column:
    """``2026-01-31`` of a UTC timestamp. Read from its text, so no session time zone is involved."""
    return F.substring(at.cast("string"), 1, 10)


def run_stamp(at: Column) -> Column:
    """``2026-01-31 03:00 UTC``."""
    return F.concat(F.substring(at.cast("string"), 1, 16), F.lit(" UTC"))


def employer_label(employer: Column) -> Column:
    label = F.lit("Unknown")
    for kind, shown in P.EMPLOYER_LABELS.items():
        label = F.when(employer == kind, shown).otherwise(label)
    return label


def posting_block() -> Column:
    """One Markdown block per report row; the sponsorship line exists in tier 3 only.

    ``concat_ws`` leaves out NULL lines, which is how the optional line vanishes.
    """
    c = F.col
    evidence = F.nullif(c("sponsorship_evidence"), F.lit(""))
    sponsor_line = F.when(
        c("location_tier") == 3,
        F.concat(
            F.lit("Sponsorship signal: "), or_default(c("sponsorship_confidence"), "unconfirmed"),
            F.coalesce(F.concat(F.lit(" — "), evidence), F.lit("")),
        ),
    )
    return F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("## "), or_default(c("company"), "Unknown company"), F.lit(" — "), or_default(c("title"), "Unknown title")),
        F.concat(
            F.lit("Location: "), or_default(c("location"), "Not specified"),
            F.lit(" | Employer type: "), employer_label(c("employer_type")),
        ),
        F.concat(
            F.lit("Match score: "), F.coalesce(c("role_fit_score").cast("string"), F.lit("None")),
            F.lit("/100 — "), text_or_empty(c("match_reason")),
        ),
        F.concat(F.lit("Salary: "), or_default(c("salary_display"), P.NOT_DISCLOSED)),
        sponsor_line,
        F.concat(F.lit("Apply link: "), c("url")),
        F.lit(""),
        F.lit("### JD (paste this into CV Project)"),
        F.lit("```"),
        or_default(c("description"), "(no description text available)"),
        F.lit("```"),
        F.lit("---"),
    )
