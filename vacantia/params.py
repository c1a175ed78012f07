"""Typed run parameters and the fixed values the rules depend on."""
from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

# --- Fixed values ---------------------------------------------------------
# Word lists, thresholds, patterns and output texts that decide results.

ROLE_TITLES = (
    "Product Owner", "Product Manager", "Technical Product Manager",
    "Technical Product Owner", "Senior Product Manager", "APM",
)
ALWAYS_ROLE_TITLES = ("product manager", "product owner")
DOMINANT_THEMES = (
    "marketing", "growth marketing", "brand", "campaign management",
    "demand generation", "content marketing",
)
MARKETING_WORDS = (
    "campaign", "seo", "sem", "social media", "media buying", "content calendar",
    "email marketing", "performance marketing", "brand awareness", "influencer",
    "paid media", "ad spend", "conversion campaigns",
)
PRODUCT_WORDS = (
    "roadmap", "backlog", "user stories", "sprint", "api", "integration",
    "technical", "engineering", "prd", "stakeholder", "oauth", "saas",
    "wireframe", "user research", "a/b test", "feature",
)
MARKETING_MIN_HITS = 3

DOMESTIC_CITIES = ("Gurugram", "Gurgaon", "Bangalore", "Bengaluru", "Hyderabad", "Mumbai")
INTERNATIONAL_REGIONS = ("Europe", "United States", "USA", "US")
HOME_COUNTRY_WORD = "india"

PRIORITISED_WORDS = (
    "B2B SaaS", "product-based", "product company", "PaaS", "API platform",
    "integration platform", "integrations", "OAuth", "ATS", "HRTech",
    "enterprise software",
)
DEPRIORITISED_WORDS = (
    "IT services", "staff augmentation", "staffing", "consulting",
    "client projects", "professional services",
)
SERVICE_PENALTY = 20

EXCLUDED_WORDS = (
    "intern", "internship", "trainee", "entry level", "entry-level",
    "contract to hire", "contract-to-hire", "freelance", "unpaid", "stipend",
    "equity only", "equity-only",
)
EXCLUDED_EMPLOYMENT = ("contract", "temporary", "internship", "freelance")

CONFIRMED_PHRASES = (
    "visa sponsorship", "we sponsor", "h1b sponsorship", "sponsor h1b",
    "relocation assistance", "relocation package", "skilled worker visa",
    "sponsor a visa",
)
CONFIDENCE_RANK = {"unconfirmed": 0, "likely": 1, "confirmed": 2}

SEARCH_WORDS = (
    "Product Manager", "Product Owner", "Technical Product Manager",
    "Technical Product Owner",
)
FALLBACK_FX = {"USD": 87.0, "EUR": 94.0, "GBP": 110.0}
FALLBACK_FX_LABEL = "fallback static FX rates from config.yaml (live lookup unavailable)"
MONEY_SIGNS = ("₹", "Rs", "INR", "$", "USD", "€", "EUR", "£", "GBP")  # how MONEY_SPAN can begin
SYMBOL_CURRENCY = {
    "₹": "INR", "rs": "INR", "inr": "INR", "$": "USD", "usd": "USD",
    "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP",
}

# Patterns ({s} = one whitespace character).
YEARS_SPAN = r"(\d{1,2}){s}*(?:\+)?{s}*(?:-|–|to){s}*(\d{1,2}){s}*\+?{s}*years?"
YEARS_FROM = r"(\d{1,2}){s}*\+{s}*years?"
YEARS_AT_LEAST = r"(?:minimum|min\.?|at least){s}*(\d{1,2}){s}*years?"
SENIOR_TITLE = r"\b(director|vp|vice president|head of|chief)\b"
LPA_SPAN = r"([\d.]+){s}*(?:-|–|to){s}*([\d.]+){s}*LPA"
MONEY_SPAN = (
    r"(₹|Rs\.?|INR|\$|USD|€|EUR|£|GBP){s}*([\d,.]+){s}*(?:k|K)?{s}*(?:-|–|to){s}*"
    r"(₹|Rs\.?|INR|\$|USD|€|EUR|£|GBP)?{s}*([\d,.]+){s}*(k|K)?"
)

STATUSES = (
    "new", "matched", "cv_generated", "queued_for_review", "applied", "rejected",
    "skipped",
)
REPORTABLE_STATUSES = ("matched", "queued_for_review")

# Texts that appear in results.
REASON_ROLE = "heuristic: title/lede doesn't read as a product management/ownership role"
REASON_NOT_PRODUCT = "not a product management/ownership role"
# ({} = a value of the row)
MARKETING_TEXT = "heuristic: marketing-signal density ({}) exceeds product-signal density ({}) despite the title"
SENIORITY_TEXT = "seniority mismatch ({})"
SPONSORSHIP_TEXT = "international listing with sponsorship_confidence={}, below required {}"
MATCH_TEXT = "Heuristic match: {} product/SaaS keyword hit(s), seniority={}, employer_type={}"
ESTIMATE_NOTE = "AI-estimated ({}) - not a live Glassdoor/AmbitionBox/Levels.fyi query"
REPORT_HEAD = (
    "# Job Digest — {}\n\n{} posting(s) matched above threshold. All compensation figures are in INR; "
    "foreign-currency conversions use {}."
)
REASON_MARKETING = "responsibilities skew marketing despite title"
TIER_HEADINGS = {
    1: "## \U0001F3E0 Remote",
    2: "## \U0001F4CD Domestic (Gurugram/Bangalore/Hyderabad/Mumbai)",
    3: "## ✈️ International (Europe/USA — sponsorship confirmed or likely)",
}
EMPLOYER_LABELS = {"product": "Product/PaaS-SaaS", "service": "Service-based"}
NO_MATCHES = "_No matches this run._"
NOT_DISCLOSED = "Not disclosed"
CACHED_NOTE = "cached estimate"
DEFAULT_BASIS = "AI market estimate"
ANYWHERE = "Worldwide (remote)"

# Cuts that a caller may ask for; a run without them reads, keeps and asks everything.
CUTS = {
    "role_text_chars": 300,
    "max_description_chars": 12000,
    "per_source_cap": 40,
    "max_pages": 3,
    "min_description_chars": 400,
    "max_failures_in_row": 3,
}
# --- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class Params:
    """Everything a run can be tuned with; defaults are the fixed values above. A cut of None means no cut."""

    role_titles: tuple[str, ...] = ROLE_TITLES
    dominant_themes: tuple[str, ...] = DOMINANT_THEMES
    floor_years: int = 4
    ceiling_years: int = 10
    domestic_cities: tuple[str, ...] = DOMESTIC_CITIES
    international_regions: tuple[str, ...] = INTERNATIONAL_REGIONS
    prioritised: tuple[str, ...] = PRIORITISED_WORDS
    deprioritised: tuple[str, ...] = DEPRIORITISED_WORDS
    service_penalty: int = SERVICE_PENALTY
    excluded_words: tuple[str, ...] = EXCLUDED_WORDS
    excluded_employment: tuple[str, ...] = EXCLUDED_EMPLOYMENT
    mode: str = "heuristic"
    score_threshold: int = 70
    max_description_chars: int | None = None
    role_text_chars: int | None = None
    confirmed_phrases: tuple[str, ...] = CONFIRMED_PHRASES
    min_confidence: str = "likely"
    fallback_fx: dict[str, float] = field(default_factory=lambda: dict(FALLBACK_FX))
    cache_ttl_days: int = 30
    search_words: tuple[str, ...] = SEARCH_WORDS
    per_source_cap: int | None = None
    max_pages: int | None = None
    min_description_chars: int | None = None
    max_failures_in_row: int | None = None
    enabled_sources: tuple[str, ...] = ("himalayas", "remoteok", "weworkremotely", "arbeitnow")

    def with_(self, **changes: Any) -> "Params":
        return replace(self, **changes)


# where each field sits in a nested configuration mapping
_CONFIG_PATHS = {
    "role_titles": "role.titles",
    "dominant_themes": "role.exclude_if_dominant_theme",
    "floor_years": "seniority.hard_floor_years",
    "ceiling_years": "seniority.hard_ceiling_years",
    "domestic_cities": "location.domestic_cities",
    "international_regions": "location.international_regions",
    "prioritised": "employer_type.prioritize_keywords",
    "deprioritised": "employer_type.deprioritize_keywords",
    "service_penalty": "employer_type.service_based_penalty",
    "excluded_words": "hard_filters.exclude_keywords",
    "excluded_employment": "hard_filters.exclude_employment_types",
    "score_threshold": "matching.score_threshold",
    "max_description_chars": "matching.max_description_chars",
    "confirmed_phrases": "sponsorship.confirmed_phrases",
    "min_confidence": "sponsorship.min_confidence_to_include",
    "fallback_fx": "salary.fallback_fx_to_inr",
    "cache_ttl_days": "salary.cache_ttl_days",
    "search_words": "search.keywords",
    "per_source_cap": "search.results_per_source_per_run",
    "max_pages": "search.max_pages",
    "min_description_chars": "search.min_description_chars",
    "role_text_chars": "matching.role_text_chars",
    "max_failures_in_row": "matching.max_failures_in_row",
}
# a configuration that doesn't name these means the fixed values; NULL means no cut
_FIXED_CUTS = ("max_pages", "min_description_chars", "role_text_chars", "max_failures_in_row")


def params_from_config(config: dict[str, Any]) -> Params:
    """Parameters from a nested mapping; keys that are absent keep their default."""
    found: dict[str, Any] = {name: CUTS[name] for name in _FIXED_CUTS}
    for name, path in _CONFIG_PATHS.items():
        node: Any = config
        *folders, last = path.split(".")
        for key in folders:
            node = node.get(key) if isinstance(node, dict) else None
        if not isinstance(node, dict) or last not in node:
            continue
        value = node[last]
        if value is not None or name in _FIXED_CUTS:
            found[name] = tuple(value) if isinstance(value, list) else value
    # a configuration without a mode means the model scorer
    found["mode"] = (config.get("matching") or {}).get("mode", "llm")
    if "sources" in config:
        found["enabled_sources"] = tuple(
            name
            for tier in config["sources"].values()
            for name, flags in (tier or {}).items()
            if (flags or {}).get("enabled")
        )
    return Params(**found)


def load_params(path: str) -> Params:
    """Read a JSON or (if PyYAML is present) YAML configuration file on the driver."""
    with open(path, encoding="utf-8") as handle:
        text = handle.read()
    if path.endswith(".json"):
        return params_from_config(json.loads(text))
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading a YAML configuration needs PyYAML; use JSON instead") from missing
    return params_from_config(yaml.safe_load(text))
