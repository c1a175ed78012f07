"""Column layouts of the canonical posting and of the four state tables.

All timestamps are UTC wall-clock values stored as TIMESTAMP_NTZ, so results do
not depend on the session time zone.
"""
from __future__ import annotations

from pyspark.sql import types as T

S, B, I, D, TS = T.StringType(), T.BooleanType(), T.IntegerType(), T.DoubleType(), T.TimestampNTZType()

CANONICAL_FIELDS = [
    ("title", S), ("company", S), ("location", S), ("description", S), ("url", S),
    ("source", S), ("posted_date", S), ("visa_sponsorship", B), ("remote_type", S),
    ("employment_type", S), ("salary_text", S), ("raw", S),
]
CANONICAL = [name for name, _ in CANONICAL_FIELDS]

# fields a later sighting refreshes; url, source, status and first_seen_at stay
REFRESHED = [
    "title", "company", "location", "description", "posted_date", "visa_sponsorship",
    "remote_type", "employment_type", "salary_text",
]


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


POSTINGS = _struct(
    ("url_hash", S), ("url", S), ("source", S), ("title", S), ("company", S),
    ("location", S), ("description", S), ("posted_date", S), ("visa_sponsorship", B),
    ("remote_type", S), ("employment_type", S), ("salary_text", S), ("status", S),
    ("first_seen_at", TS), ("last_seen_at", TS),
)
MATCHES = _struct(
    ("url_hash", S), ("role_fit_score", I), ("raw_role_fit_score", I), ("match_reason", S),
    ("location_tier", I), ("employer_type", S), ("sponsorship_confidence", S),
    ("sponsorship_evidence", S), ("hard_filtered", B), ("hard_filter_reason", S),
    ("matched_at", TS),
)
SALARIES = _struct(
    ("url_hash", S), ("salary_display", S), ("salary_min_inr", D), ("salary_max_inr", D),
    ("is_estimated", B), ("source_note", S), ("enriched_at", TS),
)
SALARY_CACHE = _struct(
    ("cache_key", S), ("salary_display", S), ("salary_min_inr", D), ("salary_max_inr", D),
    ("looked_up_at", TS),
)
STATE_TABLES = {
    "postings": POSTINGS,
    "matches": MATCHES,
    "salaries": SALARIES,
    "salary_lookup_cache": SALARY_CACHE,
}
MATCH_COLUMNS = [f.name for f in MATCHES if f.name not in ("url_hash", "matched_at")]
