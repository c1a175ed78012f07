"""Checking SQL for the registered queries, for an independent SQL engine (DuckDB dialect).

Each text states the expected result of one query from the same derived views. The
rules are written here a second time, in another style (lists, JSON functions, plain
window functions), so that the two sides can disagree.
"""
from __future__ import annotations

from collections.abc import Sequence

from vacantia import params as P
from vacantia.functions.html_pages import CHROME
from vacantia.functions.text import BREAK_CLASS, SPACE_CLASS, SPACES
from vacantia.operators.plugins import ESTIMATE_PROMPT, SCORING_PROMPT
from vacantia.plans.views import check_views
from vacantia.schema import REFRESHED

NOW1, NOW2, SPLIT = "1996-01-01 00:00:00", "2001-08-15 00:00:00", "1996-01-01 00:00:00"
MATCH = (
    "role_fit_score, raw_role_fit_score, match_reason, location_tier, employer_type, "
    "sponsorship_confidence, sponsorship_evidence, hard_filtered, hard_filter_reason"
)
POST = (
    "url_hash, url, source, title, company, location, description, posted_date, visa_sponsorship, "
    "remote_type, employment_type, salary_text, status, first_seen_at, last_seen_at"
)
SAL = "salary_display, salary_min_inr, salary_max_inr, is_estimated, source_note"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items: Sequence[str], lower: bool = True) -> str:
    return "[" + ", ".join(q(w.lower() if lower else w) for w in items) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {q(SPACES)})"


def key(url: str) -> str:
    return f"sha256(lower({strip(url)}))"


def hits(low: str, items: Sequence[str]) -> str:
    return f"CAST(len(list_filter({words(items)}, lambda w: contains({low}, w))) AS INTEGER)"


def first(low: str, items: Sequence[str]) -> str:
    return f"list_filter({words(items, False)}, lambda w: contains({low}, lower(w)))[1]"


def first_word(low: str, items: Sequence[str]) -> str:
    return f"list_filter({words(items)}, lambda w: regexp_matches({low}, concat('\\b', w, '\\b')))[1]"


def sql_repr(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'None' ELSE concat(chr(39), {x}, chr(39)) END"


def clean(x: str) -> str:
    x = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    x = f"regexp_replace({x}, {q(SPACE_CLASS + '*' + BREAK_CLASS + SPACE_CLASS + '*')}, chr(10), 'g')"
    return strip(x)


def html_text(x: str) -> str:
    x = f"coalesce({x}, '')"
    for tag in ("</p>", "<br>", "<br/>", "<br />", "</li>", "</div>"):
        x = f"replace({x}, {q(tag)}, chr(10))"
    x = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    for entity, char in (("&amp;", "&"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&quot;", '"')):
        x = f"replace({x}, {q(entity)}, {q(char)})"
    return clean(x)


def page_text(x: str) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', chr(10), 'g')"
    for tag in sorted(CHROME):
        x = f"regexp_replace({x}, {q(f'(?is)<{tag}[^>]*>.*?</{tag}>')}, chr(10), 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', chr(10), 'g')"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        x = f"replace({x}, {q(entity)}, {q(char)})"
    return clean(f"regexp_replace({x}, '&amp;?', '&', 'g')")


def span(pattern: str, text: str, group: int, flags: str = "(?i)") -> str:
    return f"regexp_extract({text}, {q(flags + pattern.replace('{s}', '[ ]'))}, {group})"


def years(d: str) -> tuple[str, str]:
    def n(p: str, g: int) -> str:
        return f"TRY_CAST({span(p, d, g)} AS INTEGER)"

    a, b = n(P.YEARS_SPAN, 1), n(P.YEARS_SPAN, 2)
    f, m = n(P.YEARS_FROM, 1), n(P.YEARS_AT_LEAST, 1)
    lo = f"CASE WHEN {a} IS NOT NULL THEN least({a}, {b}) ELSE coalesce({f}, {m}) END"
    hi = f"CASE WHEN {a} IS NOT NULL THEN greatest({a}, {b}) WHEN coalesce({f}, {m}) IS NOT NULL THEN 99 END"
    return lo, hi


def tier(location: str = "location", remote: str = "remote_type") -> str:
    low = f"lower(coalesce({location}, ''))"
    return (
        f"CASE WHEN {remote} = 'remote' THEN 1 WHEN {hits(low, P.DOMESTIC_CITIES)} > 0 THEN 2 "
        f"WHEN {hits(low, P.INTERNATIONAL_REGIONS)} > 0 THEN 3 WHEN contains({low}, 'india') THEN 2 ELSE 3 END"
    )


def employment_reason(x: str = "employment_type") -> str:
    return f"CASE WHEN lower({x}) IN ({', '.join(q(w) for w in P.EXCLUDED_EMPLOYMENT)}) THEN concat('employment_type=', {sql_repr(x)}, ' is excluded') END"


def rank(x: str) -> str:
    return f"CASE {x} WHEN 'confirmed' THEN 2 WHEN 'likely' THEN 1 ELSE 0 END"


def features(src: str, n: str) -> str:
    """CTE ``n``: all columns of ``src`` plus everything the rules look at."""
    lo, hi = years("d")
    return f"""{n}_low AS (SELECT *, coalesce(description, '') AS d, lower(coalesce(description, '')) AS dl,
  lower(concat(title, ' ', description)) AS hay, lower(concat(title, ' ', substring(coalesce(description, ''), 1, 300))) AS opening FROM {src}),
{n}_hit AS (SELECT *, {hits('dl', P.MARKETING_WORDS + P.DOMINANT_THEMES)} AS mk, {hits('dl', P.PRODUCT_WORDS)} AS pr,
  {hits('dl', P.PRIORITISED_WORDS)} AS pri, {hits('dl', P.DEPRIORITISED_WORDS)} AS dep, {hits('dl', P.SEARCH_WORDS)} AS sea,
  {lo} AS lo, {hi} AS hi, {tier()} AS tier, {first('dl', P.CONFIRMED_PHRASES)} AS evidence,
  {first_word('hay', P.EXCLUDED_WORDS)} AS kw, {hits('opening', P.ROLE_TITLES + P.ALWAYS_ROLE_TITLES)} > 0 AS is_role FROM {n}_low),
{n}_sen AS (SELECT *, CASE WHEN regexp_matches(title, {q('(?i)' + P.SENIOR_TITLE)}) THEN 'senior' WHEN lo IS NULL THEN 'unclear'
   WHEN hi < 4 THEN 'junior' WHEN lo >= 10 THEN 'senior' ELSE 'fits' END AS sen,
  CASE WHEN dep > 0 AND dep > pri THEN 'service' ELSE 'product' END AS emp,
  CASE WHEN evidence IS NULL THEN 'unconfirmed' ELSE 'confirmed' END AS conf FROM {n}_hit),
{n} AS (SELECT *, {employment_reason()} AS r1, CASE WHEN kw IS NOT NULL THEN concat('JD contains excluded keyword ', chr(39), kw, chr(39)) END AS r2,
  CASE WHEN NOT is_role THEN {q(P.REASON_ROLE)} END AS r3,
  CASE WHEN mk >= 3 AND mk > pr THEN concat('heuristic: marketing-signal density (', mk, ') exceeds product-signal density (', pr, ') despite the title') END AS r4,
  CASE WHEN sen IN ('junior', 'senior') THEN concat('heuristic seniority mismatch (', sen, ')') END AS r5,
  CASE WHEN tier = 3 AND {rank('conf')} < 1 THEN concat('heuristic: international listing with sponsorship_confidence=', chr(39), conf, chr(39), ', below required ', chr(39), 'likely', chr(39)) END AS r6,
  CAST(least(30 + 5 * least(sea + pri, 8) + CASE WHEN sen = 'fits' THEN 20 ELSE 10 END + CASE WHEN contains(lower(title), 'technical') THEN 10 ELSE 0 END, 100) AS INTEGER) AS raw_score,
  concat('Heuristic match: ', sea + pri, ' product/SaaS keyword hit(s), seniority=', sen, ', employer_type=', emp) AS why FROM {n}_sen)"""


WEIGHTED = "CAST(greatest(0, least(100, raw_score - CASE WHEN emp = 'service' THEN 20 ELSE 0 END)) AS INTEGER)"


def scored(src: str, n: str) -> str:
    """CTE ``n``: columns of ``src`` and the match columns of the rule scorer."""
    early, passed = "coalesce(r1, r2, r3, r4, r5)", "coalesce(r1, r2, r3, r4, r5, r6) IS NULL"
    return features(src, f"{n}_f") + f""",
{n} AS (SELECT s.*, CASE WHEN {passed} THEN {WEIGHTED} END AS role_fit_score, CASE WHEN {passed} THEN raw_score END AS raw_role_fit_score,
  CASE WHEN {passed} THEN why ELSE '' END AS match_reason, CASE WHEN {early} IS NULL THEN tier END AS location_tier,
  CASE WHEN {early} IS NULL THEN emp END AS employer_type,
  CASE WHEN {early} IS NULL AND tier = 3 THEN conf END AS sponsorship_confidence,
  CASE WHEN {early} IS NULL AND tier = 3 THEN evidence END AS sponsorship_evidence,
  NOT ({passed}) AS hard_filtered, coalesce(r1, r2, r3, r4, r5, r6) AS hard_filter_reason FROM {n}_f s)"""


KEYED = f"keyed AS (SELECT *, {key('url')} AS url_hash FROM sightings WHERE url <> '' AND title <> '')"


def collapse(src: str, n: str) -> str:
    last = ", ".join(f"l.{x}" for x in REFRESHED)
    return f"""{n}_r AS (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY seen_at, ord) AS rf,
  row_number() OVER (PARTITION BY url_hash ORDER BY seen_at DESC, ord DESC) AS rl, count(*) OVER (PARTITION BY url_hash) AS sightings FROM {src}),
{n} AS (SELECT l.url_hash, f.url, f.source, {last}, f.ord AS first_ord, l.ord AS last_ord, l.sightings
  FROM (SELECT * FROM {n}_r WHERE rl = 1) l JOIN (SELECT url_hash, url, source, ord FROM {n}_r WHERE rf = 1) f USING (url_hash))"""


STATES = f"""{KEYED},
b1 AS (SELECT * FROM keyed WHERE seen_at < TIMESTAMP '{SPLIT}'), b2 AS (SELECT * FROM keyed WHERE seen_at >= TIMESTAMP '{SPLIT}'),
{collapse('b1', 'c1')},
{collapse('b2', 'c2')},
st1 AS (SELECT url_hash, url, source, {', '.join(REFRESHED)}, 'new' AS status, TIMESTAMP '{NOW1}' AS first_seen_at, TIMESTAMP '{NOW1}' AS last_seen_at FROM c1),
up2 AS (SELECT coalesce(o.url_hash, n.url_hash) AS url_hash, CASE WHEN o.url_hash IS NULL THEN n.url ELSE o.url END AS url,
  CASE WHEN o.url_hash IS NULL THEN n.source ELSE o.source END AS source,
  {', '.join(f'CASE WHEN n.url_hash IS NULL THEN o.{x} ELSE n.{x} END AS {x}' for x in REFRESHED)},
  coalesce(o.status, 'new') AS status, coalesce(o.first_seen_at, TIMESTAMP '{NOW2}') AS first_seen_at,
  CASE WHEN n.url_hash IS NULL THEN o.last_seen_at ELSE TIMESTAMP '{NOW2}' END AS last_seen_at,
  CASE WHEN n.url_hash IS NOT NULL THEN o.url_hash IS NULL END AS is_new, coalesce(n.sightings, 0) AS sightings
  FROM st1 o FULL OUTER JOIN c2 n ON o.url_hash = n.url_hash),
st2 AS (SELECT * EXCLUDE (is_new, sightings) FROM up2)"""
LATEST = f"{KEYED},\n{collapse('keyed', 'latest')}"

RATES = "CASE cur WHEN 'LPA' THEN 100000.0::DOUBLE WHEN 'INR' THEN 1.0::DOUBLE WHEN 'USD' THEN 87.0::DOUBLE WHEN 'EUR' THEN 94.0::DOUBLE WHEN 'GBP' THEN 110.0::DOUBLE END"


def lpa(t: str) -> tuple[str, str]:
    return tuple(f"TRY_CAST({span(P.LPA_SPAN, t, g)} AS DOUBLE)" for g in (1, 2))


def money(t: str) -> tuple[str, str, str]:
    sym = f"rtrim(lower({span(P.MONEY_SPAN, t, 1, '')}), '.')"
    cur = f"CASE {sym} " + " ".join(f"WHEN {q(s)} THEN {q(code)}" for s, code in P.SYMBOL_CURRENCY.items()) + " END"
    scale = f"(CASE WHEN {span(P.MONEY_SPAN, t, 5, '')} <> '' THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END)"
    lo, hi = (f"TRY_CAST(replace({span(P.MONEY_SPAN, t, g, '')}, ',', '') AS DOUBLE)" for g in (2, 4))
    ok = f"{lo} IS NOT NULL AND {hi} IS NOT NULL"
    return f"CASE WHEN {ok} THEN {cur} END", f"CASE WHEN {ok} THEN {lo} * {scale} END", f"CASE WHEN {ok} THEN {hi} * {scale} END"


def stated(src: str, n: str) -> str:
    """CTE ``n``: columns of ``src`` plus cur, low, high, min_inr, max_inr (NULL = not stated)."""
    def parse(t: str) -> str:
        a, b = lpa(t)
        c, lo, hi = money(t)
        return (
            f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {{'cur': 'LPA', 'low': {a}, 'high': {b}}} "
            f"WHEN {c} IS NOT NULL THEN {{'cur': {c}, 'low': {lo}, 'high': {hi}}} END"
        )

    return f"""{n}_p AS (SELECT *, coalesce({parse("coalesce(salary_text, '')")}, {parse("coalesce(description, '')")}) AS s FROM {src}),
{n}_c AS (SELECT * EXCLUDE (s), s.cur AS cur, s.low AS low, s.high AS high FROM {n}_p),
{n} AS (SELECT *, low * {RATES} AS min_inr, high * {RATES} AS max_inr FROM {n}_c)"""


STATED_DISPLAY = (
    "CASE WHEN cur = 'LPA' THEN concat('₹', format('{:g}', low), '-', format('{:g}', high), ' LPA, stated') "
    "ELSE concat('₹', format('{:.1f}', min_inr / 100000), '-', format('{:.1f}', max_inr / 100000), ' LPA, stated (converted from ', cur, ')') END"
)


def norm(x: str) -> str:
    return f"regexp_replace(lower({strip(f'coalesce({x}, {q(str())})')}), {q(SPACE_CLASS + '+')}, ' ', 'g')"


CACHE_KEY = f"concat({norm('company')}, '|', {norm('title')}, '|', {norm('location')})"


def fill(template: str, *names: str) -> str:
    text = q(template)
    for name in names:
        value = "substring(coalesce(description, ''), 1, 12000)" if name == "description" else f"coalesce({name}, 'None')"
        text = f"replace({text}, '{{{name}}}', {value})"
    return text


ASK_SCORE = fill(SCORING_PROMPT, "title", "company", "location", "source", "description")
ASK_PAY = fill(ESTIMATE_PROMPT, "title", "company", "location", "remote_type")


def priced(src: str, n: str, now: str, cache: str | None, estimator: bool = False, ord_: str = "ord") -> str:
    """CTEs ``n`` (url_hash, ord, salary columns) and ``n_new`` (cache rows written)."""
    known = f"(SELECT * FROM {cache} WHERE looked_up_at > TIMESTAMP '{now}' - INTERVAL 31 DAY)" if cache else (
        "(SELECT '' AS cache_key, '' AS salary_display, 0.0::DOUBLE AS salary_min_inr, 0.0::DOUBLE AS salary_max_inr, TIMESTAMP '2000-01-01' AS looked_up_at WHERE false)")
    guess_ok = "len % 4 <> 0" if estimator else "false"
    return stated(src, f"{n}_s") + f""",
{n}_k AS (SELECT *, {CACHE_KEY} AS cache_key, row_number() OVER (PARTITION BY {CACHE_KEY} ORDER BY {ord_}) AS nth, length({ASK_PAY}) AS len FROM {n}_s WHERE cur IS NULL),
{n}_first AS (SELECT f.cache_key, c.cache_key IS NOT NULL AS hit,
  CASE WHEN c.cache_key IS NOT NULL THEN c.salary_display WHEN {guess_ok} THEN concat('Est. ₹', format('{{:g}}', (len % 20)::DOUBLE), '-', format('{{:g}}', (20 + len % 10)::DOUBLE), ' LPA') ELSE 'Not disclosed' END AS salary_display,
  CASE WHEN c.cache_key IS NOT NULL THEN c.salary_min_inr WHEN {guess_ok} THEN (len % 20) * 100000.0::DOUBLE END AS salary_min_inr,
  CASE WHEN c.cache_key IS NOT NULL THEN c.salary_max_inr WHEN {guess_ok} THEN (20 + len % 10) * 100000.0::DOUBLE END AS salary_max_inr,
  CASE WHEN {guess_ok} THEN 'AI-estimated (length) - not a live Glassdoor/AmbitionBox/Levels.fyi query' END AS note
  FROM (SELECT * FROM {n}_k WHERE nth = 1) f LEFT JOIN {known} c ON c.cache_key = f.cache_key),
{n} AS (SELECT url_hash, {ord_}, {STATED_DISPLAY} AS salary_display, min_inr AS salary_min_inr, max_inr AS salary_max_inr, false AS is_estimated,
  CASE WHEN cur = 'LPA' THEN 'stated in JD' ELSE concat('stated in JD as ', cur, ', converted to INR') END AS source_note FROM {n}_s WHERE cur IS NOT NULL
 UNION ALL SELECT k.url_hash, k.{ord_}, f.salary_display, f.salary_min_inr, f.salary_max_inr, contains(f.salary_display, 'Est.') AS is_estimated,
  CASE WHEN f.hit OR k.nth > 1 THEN 'cached estimate' ELSE f.note END FROM {n}_k k JOIN {n}_first f ON f.cache_key = k.cache_key),
{n}_new AS (SELECT cache_key, salary_display, salary_min_inr, salary_max_inr, TIMESTAMP '{now}' AS looked_up_at FROM {n}_first WHERE NOT hit)"""


def run(which: int) -> str:
    """CTEs of a whole run: m (matches), ps (postings with status), todo, sal, sal_new, rows (report)."""
    st, now, x = f"st{which}", (NOW1, NOW2)[which - 1], which
    return scored(st, f"sc{x}") + f""",
m{x} AS (SELECT url_hash, {MATCH}, TIMESTAMP '{now}' AS matched_at FROM sc{x}),
ps{x} AS (SELECT s.* REPLACE (CASE WHEN m.hard_filtered THEN 'skipped' ELSE 'matched' END AS status) FROM {st} s JOIN m{x} m USING (url_hash)),
todo{x} AS (SELECT p.*, m.* EXCLUDE (url_hash, matched_at, hard_filtered), p.url_hash AS ord FROM ps{x} p JOIN m{x} m USING (url_hash)
  WHERE NOT m.hard_filtered AND m.role_fit_score >= 70),
{priced(f'todo{x}', f'sal{x}', now, 'cache')},
rows{x} AS (SELECT t.*, s.salary_display FROM todo{x} t LEFT JOIN sal{x} s USING (url_hash))"""


BLOCK = """concat('---', chr(10), '## ', company, ' — ', title, chr(10), 'Location: ', coalesce(nullif(location, ''), 'Not specified'), ' | Employer type: ',
 CASE employer_type WHEN 'product' THEN 'Product/PaaS-SaaS' WHEN 'service' THEN 'Service-based' ELSE 'Unknown' END, chr(10),
 'Match score: ', role_fit_score, '/100 — ', match_reason, chr(10), 'Salary: ', coalesce(salary_display, 'Not disclosed'), chr(10),
 CASE WHEN location_tier = 3 THEN concat('Sponsorship signal: ', coalesce(sponsorship_confidence, 'unconfirmed'), CASE WHEN sponsorship_evidence IS NULL THEN '' ELSE concat(' — ', sponsorship_evidence) END, chr(10)) ELSE '' END,
 'Apply link: ', url, chr(10), chr(10), '### JD (paste this into CV Project)', chr(10), '```', chr(10), description, chr(10), '```', chr(10), '---')"""

DOCUMENT = f"""doc AS (SELECT 0 AS section, 0 AS part, 0 AS score, '' AS url_hash, concat('# Job Digest — 2001-08-15 00:00 UTC', chr(10), chr(10), (SELECT count(*) FROM rows2),
  ' posting(s) matched above threshold. All compensation figures are in INR; foreign-currency conversions use ', {q(P.FALLBACK_FX_LABEL)}, '.') AS text
 UNION ALL SELECT t, 0, 0, '', concat(chr(10), heading, CASE WHEN t IN (SELECT location_tier FROM rows2) THEN '' ELSE concat(chr(10), chr(10), '_No matches this run._') END)
  FROM (VALUES {', '.join(f'({k}, {q(v)})' for k, v in P.TIER_HEADINGS.items())}) h(t, heading)
 UNION ALL SELECT location_tier, 1, role_fit_score, url_hash, concat(chr(10), {BLOCK}) FROM rows2)"""


# ---- JSON helpers ---------------------------------------------------------------

def js(k: str, j: str = "j") -> str:
    return f"({j}->>'$.{k}')"


def kind(k: str, j: str = "j") -> str:
    return f"json_type({j}, '$.{k}')"


def truthy(k: str, j: str = "j") -> str:
    return (
        f"CASE {kind(k, j)} WHEN 'NULL' THEN false WHEN 'BOOLEAN' THEN {js(k, j)} = 'true' WHEN 'VARCHAR' THEN {js(k, j)} <> '' "
        f"WHEN 'ARRAY' THEN {js(k, j)} <> '[]' WHEN 'OBJECT' THEN {js(k, j)} <> '{{}}' ELSE coalesce(TRY_CAST({js(k, j)} AS DOUBLE) <> 0, false) END"
    )


def text_if(k: str) -> str:
    return f"CASE WHEN {truthy(k)} THEN {js(k)} END"


def get(k: str) -> str:
    return f"CASE WHEN {kind(k)} IS NULL THEN '' ELSE {js(k)} END"


def shown(k: str, missing: str = "") -> str:
    return f"CASE WHEN {kind(k)} IS NULL THEN {q(missing)} WHEN {kind(k)} = 'NULL' THEN 'None' ELSE {js(k)} END"


def shown_if(k: str) -> str:
    return f"CASE WHEN {truthy(k)} THEN {js(k)} ELSE '' END"


def feed(name: str, columns: dict[str, str], where: str = "true") -> tuple[str, str]:
    order = ["title", "company", "location", "description", "url", "source", "posted_date", "visa_sponsorship",
             "remote_type", "employment_type", "salary_text"]
    filled = {c: "CAST(NULL AS BOOLEAN)" if c == "visa_sponsorship" else "CAST(NULL AS VARCHAR)" for c in order} | columns
    picked = ", ".join(f"{filled[c]} AS {c}" for c in order)
    return f"raw_{name}", (
        f"j_{name} AS (SELECT * EXCLUDE (raw), CAST(raw AS JSON) AS j FROM raw_{name} WHERE json_valid(raw)), "
        f"{name} AS (SELECT ord, {picked} FROM j_{name} WHERE {where})"
    )


def either(a: str, b: str) -> str:
    return f"(({truthy(a)}) OR ({truthy(b)}))"


_PLACES = f"array_to_string(json_extract_string(j, '$.locationRestrictions[*]'), ', ')"
FEEDS = dict([
    ("himalayas", feed("himalayas", {
        "title": strip(get("title")), "company": strip(get("companyName")),
        "location": f"CASE WHEN {truthy('locationRestrictions')} THEN {_PLACES} ELSE 'Worldwide (remote)' END",
        "description": f"coalesce({text_if('description')}, {text_if('excerpt')}, '')",
        "url": f"coalesce({text_if('applicationLink')}, concat('https://himalayas.app/jobs/', {shown('guid')}))",
        "source": "'himalayas'", "posted_date": js("pubDate"),
        "remote_type": f"CASE WHEN NOT ({truthy('locationRestrictions')}) OR regexp_matches(lower({_PLACES}), 'worldwide|india') THEN 'remote' END",
        "employment_type": js("employmentType"),
        "salary_text": f"CASE WHEN {either('minSalary', 'maxSalary')} THEN {strip('concat(' + shown_if('currency') + ', chr(32), ' + shown_if('minSalary') + ', chr(45), ' + shown_if('maxSalary') + ', chr(32), ' + shown_if('salaryPeriod') + ')')} END",
    })),
    ("remoteok", feed("remoteok", {
        "title": strip(f"coalesce({text_if('position')}, '')"), "company": strip(f"coalesce({text_if('company')}, '')"),
        "location": f"coalesce({text_if('location')}, 'Worldwide (remote)')", "description": html_text(js("description")),
        "url": f"coalesce({text_if('url')}, 'https://remoteok.com/remote-jobs/' || coalesce({text_if('id')}, {text_if('slug')}), '')",
        "source": "'remoteok'", "posted_date": js("date"), "remote_type": "'remote'",
        "salary_text": f"CASE WHEN {either('salary_min', 'salary_max')} THEN concat('$', {shown_if('salary_min')}, '-', {shown_if('salary_max')}) END",
    }, where=f"{kind('legal')} IS NULL AND ({truthy('position')})")),
    ("jsearch", feed("jsearch", {
        "title": get("job_title"), "company": get("employer_name"),
        "location": f"coalesce(nullif(concat_ws(', ', {text_if('job_city')}, {text_if('job_country')}), ''), 'Not specified')",
        "description": get("job_description"), "url": get("job_apply_link"), "source": "'jsearch'",
        "posted_date": js("job_posted_at_datetime_utc"), "remote_type": f"CASE WHEN {truthy('job_is_remote')} THEN 'remote' END",
        "employment_type": js("job_employment_type"),
        "salary_text": f"CASE WHEN {either('job_min_salary', 'job_max_salary')} THEN {strip('concat(' + shown('job_salary_currency') + ', chr(32), ' + shown('job_min_salary') + ', chr(45), ' + shown('job_max_salary') + ', chr(32), ' + shown('job_salary_period') + ')')} END",
    })),
    ("adzuna", feed("adzuna", {
        "title": get("title"),
        "company": f"CASE WHEN ({truthy('company')}) AND {kind('company.display_name')} IS NOT NULL THEN {js('company.display_name')} ELSE '' END",
        "location": f"coalesce(nullif({js('location.display_name')}, ''), upper(country))",
        "description": get("description"), "url": get("redirect_url"), "source": "concat('adzuna_', country)",
        "posted_date": js("created"),
        "employment_type": f"CASE WHEN {truthy('contract_type')} THEN {js('contract_type')} ELSE {js('contract_time')} END",
        "salary_text": f"CASE WHEN {either('salary_min', 'salary_max')} THEN concat({shown('salary_min')}, '-', {shown('salary_max')}) END",
    })),
    ("arbeitnow", feed("arbeitnow", {
        "title": get("title"), "company": get("company_name"), "location": f"coalesce({text_if('location')}, 'Europe')",
        "description": html_text(js("description")), "url": get("url"), "source": "'arbeitnow'",
        "posted_date": text_if("created_at"), "visa_sponsorship": f"TRY_CAST({js('visa_sponsorship')} AS BOOLEAN)",
        "remote_type": f"CASE WHEN {truthy('remote')} THEN 'remote' ELSE 'onsite' END", "employment_type": "(j->>'$.job_types[0]')",
    })),
])


def _rss() -> str:
    def tag(name: str) -> str:
        return strip(f"regexp_extract(item_xml, '(?s)<{name}>(.*?)</{name}>', 1)")

    body = "regexp_extract(item_xml, '(?s)CDATA\\[(.*?)\\]\\]', 1)"
    return f"""rss_t AS (SELECT ord, {tag('title')} AS t, {tag('link')} AS url, nullif({tag('pubDate')}, '') AS posted_date, {html_text(body)} AS description
  FROM raw_rss WHERE item_xml LIKE '%</item>'),
weworkremotely AS (SELECT ord, CASE WHEN contains(t, ': ') THEN {strip("substring(t, instr(t, ': ') + 2)")} ELSE t END AS title,
  CASE WHEN contains(t, ': ') THEN {strip("substring(t, 1, instr(t, ': ') - 1)")} ELSE 'Unknown' END AS company, 'Worldwide (remote)' AS location, description, url,
  'weworkremotely' AS source, posted_date, CAST(NULL AS BOOLEAN) AS visa_sponsorship, 'remote' AS remote_type,
  CAST(NULL AS VARCHAR) AS employment_type, CAST(NULL AS VARCHAR) AS salary_text FROM rss_t)"""


def verdict_ctes(src: str, n: str) -> str:
    """CTE ``n``: match columns and ``failed`` for rows with a ``reply``."""
    typed = (
        f"CASE WHEN {kind('role_fit_score')} IS NULL THEN 0 WHEN {kind('role_fit_score')} = 'NULL' THEN NULL "
        f"ELSE TRY_CAST({js('role_fit_score')} AS INTEGER) END"
    )
    conf = js("sponsorship_confidence")
    return f"""{n}_j AS (SELECT *, CASE WHEN json_valid(regexp_extract(reply, '(?s)\\{{.*\\}}')) THEN CAST(regexp_extract(reply, '(?s)\\{{.*\\}}') AS JSON) END AS j,
  {first_word("lower(concat(title, ' ', description))", P.EXCLUDED_WORDS)} AS kw, {employment_reason()} AS r1, {tier()} AS tier FROM {src}),
{n}_f AS (SELECT *, CASE WHEN {kind('is_technical_product_role')} IS NULL THEN true ELSE {truthy('is_technical_product_role')} END AS is_role,
  {truthy('is_marketing_flavored')} AS is_marketing, {js('seniority_signal')} AS sen, {js('employer_type')} AS emp, {conf} AS conf,
  {js('sponsorship_evidence')} AS evidence, {get('reason')} AS why, {typed} AS raw_score,
  coalesce(r1, CASE WHEN kw IS NOT NULL THEN concat('JD contains excluded keyword ', chr(39), kw, chr(39)) END) AS keyword FROM {n}_j),
{n}_g AS (SELECT *, CASE WHEN j IS NULL THEN NULL WHEN NOT is_role THEN {q(P.REASON_NOT_PRODUCT)} WHEN is_marketing THEN {q(P.REASON_MARKETING)}
   WHEN sen IN ('junior', 'senior') THEN concat('seniority mismatch (', sen, ')') END AS early,
  CASE WHEN tier = 3 AND {rank('conf')} < 1 THEN concat('international listing with sponsorship_confidence=', {sql_repr('conf')}, ', below required ', chr(39), 'likely', chr(39)) END AS late FROM {n}_f),
{n} AS (SELECT s.*, CASE WHEN coalesce(keyword, early, late) IS NULL THEN {WEIGHTED} END AS role_fit_score,
  CASE WHEN coalesce(keyword, early, late) IS NULL THEN raw_score END AS raw_role_fit_score,
  CASE WHEN keyword IS NULL THEN why ELSE '' END AS match_reason,
  CASE WHEN coalesce(keyword, early) IS NULL THEN tier END AS location_tier, CASE WHEN coalesce(keyword, early) IS NULL THEN emp END AS employer_type,
  CASE WHEN coalesce(keyword, early) IS NULL THEN conf END AS sponsorship_confidence,
  CASE WHEN coalesce(keyword, early) IS NULL THEN evidence END AS sponsorship_evidence,
  coalesce(keyword, early, late) IS NOT NULL AS hard_filtered, coalesce(keyword, early, late) AS hard_filter_reason,
  keyword IS NULL AND (j IS NULL OR (coalesce(early, late) IS NULL AND raw_score IS NULL)) AS failed FROM {n}_g s)"""


JSON_REPLY = "SELECT ord, CASE WHEN json_valid(regexp_extract(reply, '(?s)\\{.*\\}')) THEN CAST(regexp_extract(reply, '(?s)\\{.*\\}') AS JSON) END AS j FROM "


def all_checks() -> dict[str, str]:
    S = check_views()                       # WITH sightings AS (...)
    F = f"{S},\n{features('sightings', 'f')}\n"
    L = f"{S},\n{LATEST},\n{scored('latest', 'sc')},\npassing AS (SELECT * FROM sc WHERE NOT hard_filtered AND role_fit_score >= 70)\n"
    ST = f"{S},\n{STATES}\n"
    STC = f"{check_views('cache')},\n{STATES}"
    RUN2, RUN1 = f"{STC},\n{run(2)}", f"{STC},\n{run(1)}"
    BOTH = f"{STC},\n{run(1)},\n{run(2)}"
    out: dict[str, str] = {}

    for name, (raw, ctes) in FEEDS.items():
        out[f"src_{name}"] = f"{check_views(raw)},\n{ctes}\nSELECT * FROM {name}"
    page = "CAST(floor(ord / 20000) AS INTEGER)"
    out["src_weworkremotely"] = f"{check_views('raw_rss')},\n{_rss()}\nSELECT * FROM weworkremotely"
    out["landed_rss"] = f"""{check_views('raw_rss')},\n{_rss()}\nSELECT CAST(ord % 4 AS INTEGER) AS keyword_ord, {page} AS page,
 CAST(row_number() OVER (PARTITION BY ord % 4, {page} ORDER BY ord) AS INTEGER) AS place, * EXCLUDE (ord) FROM weworkremotely"""
    enabled = [("himalayas", 0), ("remoteok", 1), ("weworkremotely", 2), ("arbeitnow", 5)]
    out["union_sources"] = (
        check_views("raw_himalayas", "raw_remoteok", "raw_rss", "raw_arbeitnow") + ",\n"
        + ",\n".join(FEEDS[n][1] for n in ("himalayas", "remoteok", "arbeitnow")) + f",\n{_rss()}\n"
        + " UNION ALL ".join(f"SELECT ord, {i} AS source_ord, source, title, company, url, remote_type FROM {n}" for n, i in enabled)
    )
    out["landed_sources"] = (
        check_views("raw_himalayas", "raw_remoteok", "raw_rss", "raw_arbeitnow") + ",\n"
        + ",\n".join(FEEDS[n][1] for n in ("himalayas", "remoteok", "arbeitnow")) + f",\n{_rss()},\n"
        + f"first_of AS (SELECT * FROM himalayas WHERE company IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord % 4, {page}, ord) = 1)\n"
        + " UNION ALL ".join(
            f"SELECT {i} AS source_ord, source, title, company, url, remote_type FROM {'first_of' if n == 'himalayas' else n} WHERE title IS NOT NULL" for n, i in enabled)
    )
    out["page_cutoff"] = f"""{S}, p AS (SELECT CAST(floor(ord / 500) AS BIGINT) AS run, CAST(floor(ord % 500 / 50) AS INTEGER) + 1 AS page FROM sightings),
g AS (SELECT run, page, count(*) FILTER (WHERE NOT (run % 5 = 0 AND page = 2)) AS n_jobs, CASE run % 3 WHEN 0 THEN 2 WHEN 2 THEN 5 END AS last_page FROM p GROUP BY run, page)
SELECT * FROM g a WHERE page <= 3 AND NOT EXISTS (SELECT 1 FROM g b WHERE b.run = a.run AND b.page <= a.page AND b.n_jobs = 0)
 AND NOT EXISTS (SELECT 1 FROM g b WHERE b.run = a.run AND b.page < a.page AND b.page >= b.last_page)"""
    out["quarantine"] = f"""{check_views('raw_himalayas', 'raw_rss')},
placed AS (SELECT *, row_number() OVER (PARTITION BY ord % 4, {page} ORDER BY ord) - 1 AS pos FROM raw_himalayas WHERE json_valid(raw)),
bad AS (SELECT DISTINCT 'himalayas' AS source, ord % 4 AS k, {page} AS page, CAST(NULL AS BIGINT) AS pos, 'invalid JSON' AS error FROM raw_himalayas WHERE NOT json_valid(raw)
 UNION ALL SELECT 'himalayas', ord % 4, {page}, pos, 'company is null' FROM placed WHERE json_type(raw, '$.companyName') = 'NULL'
 UNION ALL SELECT 'weworkremotely', ord % 4, {page}, NULL, 'unreadable RSS item' FROM raw_rss WHERE item_xml NOT LIKE '%</item>')
SELECT source, CAST(k AS INTEGER) AS keyword_ord, page, pos, error FROM bad"""
    out["state_read"] = f"{ST} SELECT {POST} FROM st2"
    out["state_write"] = f"""{STC} SELECT 'postings' AS state_table, count(*) AS stored, 2 AS generation FROM st2 UNION ALL SELECT 'matches', count(*), 2 FROM st1
UNION ALL SELECT 'salaries', 0, 2 UNION ALL SELECT 'salary_lookup_cache', count(*), 2 FROM cache"""
    fx = "WITH fx_payloads AS (" + check_views("fx_payloads").split("fx_payloads AS (", 1)[1]
    fxj = f"{fx}, p AS (SELECT payload_id, CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS j FROM fx_payloads)"
    out["fx_scan"] = f"""{fxj} SELECT payload_id, CAST(len(json_keys(j, '$.rates')) AS INTEGER) AS n_rates,
 CAST(j->>'$.rates.INR' AS DOUBLE) AS inr, j->>'$.time_last_update_utc' AS stamp FROM p"""
    live = "i IS NOT NULL AND e <> 0 AND g <> 0"
    out["fx_cross_rates"] = f"""{fxj}, r AS (SELECT payload_id, j, CAST(j->>'$.rates.INR' AS DOUBLE) AS i, CAST(j->>'$.rates.EUR' AS DOUBLE) AS e, CAST(j->>'$.rates.GBP' AS DOUBLE) AS g FROM p)
SELECT payload_id, 1.0::DOUBLE AS inr, CASE WHEN {live} THEN i ELSE 87.0::DOUBLE END AS usd, CASE WHEN {live} THEN i / e ELSE 94.0::DOUBLE END AS eur,
 CASE WHEN {live} THEN i / g ELSE 110.0::DOUBLE END AS gbp,
 CASE WHEN {live} THEN concat('live FX as of ', coalesce(j->>'$.time_last_update_utc', 'unknown time')) ELSE {q(P.FALLBACK_FX_LABEL)} END AS label FROM r"""
    out["digest_sink"] = f"""{RUN2},
{DOCUMENT}, lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM doc)
SELECT 'dated' AS copy, line FROM lines UNION ALL SELECT 'latest', line FROM lines"""

    out["canonical_projection"] = f"""{S} SELECT title, company, location, coalesce(description, '') AS description, url, source, posted_date, visa_sponsorship,
 remote_type, employment_type, salary_text, CAST(NULL AS VARCHAR) AS raw FROM sightings"""
    out["url_key"] = f"{S} SELECT ord, {key('url')} AS url_hash FROM sightings"
    out["valid_posting"] = f"{S} SELECT ord, url, title FROM sightings WHERE url <> '' AND title <> ''"
    search = f"{hits('lower(title)', P.SEARCH_WORDS)} > 0"
    out["search_filter"] = f"{S} SELECT ord, title FROM sightings WHERE {search}"
    out["employment_exclude"] = f"{F} SELECT ord, r1 AS reason FROM f"
    out["keyword_exclude"] = f"{F} SELECT ord, r2 AS reason FROM f"
    out["product_role_gate"] = f"{F} SELECT ord, is_role AS is_product_role FROM f"
    out["marketing_gate"] = f"{F} SELECT ord, mk AS marketing, pr AS product, r4 AS reason FROM f"
    out["seniority"] = f"{F} SELECT ord, sen AS seniority FROM f"
    out["location_tier"] = f"{F} SELECT ord, tier AS location_tier FROM f"
    out["employer_type"] = f"{F} SELECT ord, emp AS employer_type FROM f"
    out["sponsorship_evidence"] = f"{F} SELECT ord, conf AS confidence, evidence FROM f"
    out["sponsorship_gate"] = f"{F} SELECT ord, tier, conf AS confidence, r6 AS reason FROM f"
    out["gate_ladder"] = f"""{S},
{scored('sightings', 'sc')} SELECT ord, hard_filtered, hard_filter_reason, location_tier, employer_type, sponsorship_confidence, sponsorship_evidence FROM sc"""
    out["role_fit_score"] = f"{F} SELECT ord, sea + pri AS hits, raw_score FROM f"
    out["employer_penalty"] = f"{F} SELECT ord, emp AS employer, {WEIGHTED} AS weighted_score FROM f"
    out["match_reason"] = f"{F} SELECT ord, why AS match_reason FROM f"
    out["score_postings"] = f"{L} SELECT url_hash, {MATCH} FROM sc"
    VS = check_views("verdicts")
    judged = f"{VS}, sv AS (SELECT s.*, v.reply FROM sightings s JOIN verdicts v USING (ord)),\n{verdict_ctes('sv', 'jd')}\n"
    out["verdict_gates"] = f"{judged} SELECT ord, {MATCH} FROM jd WHERE NOT failed"
    out["digest_select"] = f"{RUN2} SELECT url_hash, role_fit_score, status FROM todo2"
    out["needs_salary"] = f"{BOTH} SELECT url_hash, title FROM todo2 WHERE url_hash NOT IN (SELECT url_hash FROM sal1)"

    out["match_queue"] = f"{ST} SELECT url_hash, title, status FROM st2 WHERE url_hash NOT IN (SELECT url_hash FROM st1)"
    out["digest_join"] = f"""{BOTH} SELECT p.url_hash, p.url, p.status, m.hard_filtered, m.role_fit_score, m.match_reason, s.salary_display
FROM ps2 p JOIN m2 m USING (url_hash) LEFT JOIN sal1 s USING (url_hash)"""
    out["existing_keys"] = f"{ST} SELECT DISTINCT url_hash, url_hash NOT IN (SELECT url_hash FROM st1) AS is_new FROM b2"
    out["ttl_lookup"] = f"""{check_views('cache')}, k AS (SELECT DISTINCT {CACHE_KEY} AS cache_key FROM sightings WHERE url <> '' AND title <> '')
SELECT k.cache_key, c.salary_display, c.salary_min_inr, c.salary_max_inr, c.looked_up_at FROM k LEFT JOIN cache c
 ON c.cache_key = k.cache_key AND date_diff('second', c.looked_up_at, TIMESTAMP '{NOW2}') < 31 * 86400"""
    cur, lo, hi = money("description")
    M = f"{S}, m AS (SELECT ord, {cur} AS cur, {lo} AS low, {hi} AS high FROM sightings)"
    out["fx_join"] = f"{M} SELECT ord, cur AS currency, {RATES} AS rate_to_inr FROM m WHERE cur IS NOT NULL"
    out["page_fallback"] = f"""WITH t AS (SELECT url, regexp_extract(html, '<title>(.*?)</title>', 1) AS teaser, {page_text('html')} AS body FROM pages)
SELECT url, CASE WHEN length(teaser) < 400 AND url <> '' AND length(body) > length(teaser) THEN body ELSE teaser END AS description FROM t"""
    out["verdict_join"] = f"""{VS},
{LATEST}, lv AS (SELECT l.*, v.reply FROM latest l LEFT JOIN verdicts v ON v.ord = l.last_ord),
{verdict_ctes('lv', 'jd')} SELECT url_hash, CASE WHEN failed THEN 'queued' ELSE 'saved' END AS outcome FROM jd"""
    out["posting_lookup"] = f"""{ST} SELECT url_hash, url, title, status FROM st2 WHERE url_hash IN
 (SELECT sha256(concat('https://jobs.example.com/j/', c_custkey)) FROM customer WHERE c_mktsegment = 'BUILDING')"""

    out["phrase_hits"] = f"{F} SELECT ord, pri AS prioritised, dep AS deprioritised, sea AS search FROM f"
    out["ingest_totals"] = f"{S} SELECT source, count(*) AS postings FROM sightings GROUP BY source UNION ALL SELECT '(all)', count(*) FROM sightings"
    out["dedup_totals"] = f"""{ST} SELECT (SELECT count(*) FROM up2 WHERE is_new) AS new_count,
 (SELECT count(*) FROM b2) - (SELECT count(*) FROM up2 WHERE is_new) AS seen_count"""
    out["match_totals"] = f"""{ST}, q AS (SELECT * FROM st2 WHERE url_hash NOT IN (SELECT url_hash FROM st1)),
{scored('q', 'sq')} SELECT count(*) FILTER (WHERE NOT hard_filtered) AS passed, count(*) AS queued FROM sq"""
    out["digest_totals"] = f"{L} SELECT location_tier, count(*) AS postings FROM passing GROUP BY location_tier UNION ALL SELECT NULL, count(*) FROM passing"
    out["distinct_url_first"] = f"""{S} SELECT url, ord, ord % 4 AS keyword_ord, title, source FROM sightings
QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord % 4, ord) = 1"""
    out["distinct_url_last"] = f"""{S} SELECT url, ord, title, source, min(ord) OVER (PARTITION BY url) AS first_pos FROM sightings WHERE url <> ''
QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord DESC) = 1"""

    out["source_cap"] = f"""{S} SELECT ord, seen_at, source, title FROM sightings WHERE {search}
QUALIFY row_number() OVER (PARTITION BY source ORDER BY seen_at, ord) <= 40"""
    rounds = " UNION ALL ".join(
        f"""SELECT '{keep}' AS keep, source, url, ord, title, first_ord FROM (
 SELECT *, dense_rank() OVER (PARTITION BY source ORDER BY fr, first_ord) AS place FROM (
  SELECT r.source, r.url, r.ord, r.title, r.round, min(r.round) OVER u AS fr, min(r.ord) OVER u AS first_ord,
   row_number() OVER (PARTITION BY r.source, r.url ORDER BY r.round {way}, r.ord {way}) AS pick
  FROM rd r LEFT JOIN stop_{keep} s USING (source) WHERE (s.stop IS NULL OR r.round <= s.stop) {blank}
  WINDOW u AS (PARTITION BY r.source, r.url)) x) y WHERE pick = 1 AND place <= 40"""
        for keep, way, blank in (("first", "", ""), ("last", "DESC", "AND r.url <> ''"))
    )
    stops = ", ".join(
        f"""stop_{keep} AS (SELECT source, min(round) AS stop FROM (SELECT source, round, sum(n) OVER (PARTITION BY source ORDER BY round) AS total
 FROM (SELECT source, round, count(*) AS n FROM (SELECT source, url, min(round) AS round FROM rd {blank} GROUP BY source, url) GROUP BY source, round)) WHERE total >= 40 GROUP BY source)"""
        for keep, blank in (("first", ""), ("last", "WHERE url <> ''"))
    )
    out["keyword_round_cap"] = f"{S}, rd AS (SELECT ord, url, source, title, floor(ord / 20) AS round FROM sightings), {stops} {rounds}"
    out["batch_collapse"] = f"{S},\n{LATEST} SELECT url_hash, url, source, {', '.join(REFRESHED)}, first_ord, last_ord, sightings FROM latest"
    out["failure_cutoff"] = f"""{VS}, v AS (SELECT ord, batch, NOT contains(reply, '{{') AS failed FROM verdicts),
w AS (SELECT *, sum(failed::INT) OVER (PARTITION BY batch ORDER BY ord ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS bad FROM v),
c AS (SELECT batch, min(ord) AS cut FROM w WHERE bad = 3 GROUP BY batch)
SELECT v.ord, v.batch, v.failed FROM v LEFT JOIN c USING (batch) WHERE c.cut IS NULL OR v.ord <= c.cut"""
    K = f"{S},\n{KEYED}"
    out["run_cache_reuse"] = f"""{K},
{priced('keyed', 'pr', NOW2, None)} SELECT ord, salary_display, coalesce(source_note = 'cached estimate', false) AS reused FROM pr"""
    place = "row_number() OVER (PARTITION BY location_tier ORDER BY role_fit_score DESC, url_hash)"
    out["tier_rank"] = f"{L} SELECT location_tier, {place} AS rank, role_fit_score, url_hash FROM passing"
    out["digest_order"] = f"{L} SELECT location_tier, role_fit_score, url_hash, title FROM passing ORDER BY location_tier, role_fit_score DESC, url_hash"

    out["html_strip"] = f"SELECT page_id, {html_text('html')} AS body FROM pages"
    out["html_main_text"] = f"SELECT page_id, {page_text('html')} AS main_text FROM pages"
    out["title_split"] = f"""{S}, t AS (SELECT ord, CASE WHEN ord % 6 = 0 THEN title ELSE concat(' ', company, ': ', title, ': Remote ') END AS t FROM sightings)
SELECT ord, CASE WHEN contains(t, ': ') THEN trim(split_part(t, ': ', 1)) ELSE 'Unknown' END AS company,
 CASE WHEN contains(t, ': ') THEN trim(substring(t, instr(t, ': ') + 2)) ELSE trim(t) END AS title FROM t"""
    out["years_range"] = f"{F} SELECT ord, lo, hi FROM f"
    a, b = lpa("concat_ws(' ', salary_text, description)")
    out["salary_lpa"] = f"""{S}, l AS (SELECT ord, {a} AS a, {b} AS b FROM sightings)
SELECT ord, CASE WHEN b IS NOT NULL THEN a * 100000 END AS min_inr, CASE WHEN a IS NOT NULL THEN b * 100000 END AS max_inr FROM l"""
    out["salary_range"] = f"{M} SELECT ord, cur AS currency, low, high FROM m"
    SS = f"{S},\n{stated('sightings', 'st')}"
    out["salary_stated"] = f"{SS} SELECT ord, cur AS currency, min_inr AS salary_min_inr, max_inr AS salary_max_inr FROM st"
    out["fx_convert"] = f"{M} SELECT ord, cur AS currency, low * {RATES} AS min_inr, high * {RATES} AS max_inr FROM m WHERE cur IS NOT NULL"
    out["salary_display"] = f"{SS} SELECT ord, {STATED_DISPLAY} AS salary_display FROM st WHERE cur IS NOT NULL"
    out["cache_key"] = f"""{S}, p AS (SELECT ord, concat(' ', chr(9), company, '  Ltd ', chr(10)) AS company, title, location FROM sightings)
SELECT ord, {CACHE_KEY} AS cache_key FROM p"""
    KC = f"{check_views('cache')},\n{KEYED}"
    out["salary_cascade"] = f"{KC},\n{priced('keyed', 'pr', NOW2, 'cache')} SELECT url_hash, ord, {SAL} FROM pr"
    out["noisy_json"] = f"{VS}, p AS ({JSON_REPLY} verdicts) SELECT ord, j IS NOT NULL AS found, {js('role_fit_score')} AS score_text FROM p"
    out["verdict_fields"] = f"""{VS}, sv AS (SELECT s.*, v.reply FROM sightings s JOIN verdicts v USING (ord)),
{verdict_ctes('sv', 'jd')} SELECT ord, is_role AS is_technical_product_role, is_marketing AS is_marketing_flavored, sen AS seniority_signal, emp AS employer_type,
 conf AS sponsorship_confidence, evidence AS sponsorship_evidence, why AS reason, raw_score AS role_fit_score FROM jd_f WHERE j IS NOT NULL"""
    out["estimate_parse"] = f"""{check_views('estimate_replies')}, p AS ({JSON_REPLY} estimate_replies),
n AS (SELECT ord, CAST({js('min_lpa')} AS DOUBLE) AS a, CAST({js('max_lpa')} AS DOUBLE) AS b, {shown('basis', 'AI market estimate')} AS basis FROM p)
SELECT ord, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN concat('Est. ₹', format('{{:g}}', a), '-', format('{{:g}}', b), ' LPA') END AS salary_display,
 CASE WHEN b IS NOT NULL THEN a * 100000 END AS salary_min_inr, CASE WHEN a IS NOT NULL THEN b * 100000 END AS salary_max_inr,
 CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN concat('AI-estimated (', basis, ') - not a live Glassdoor/AmbitionBox/Levels.fyi query') END AS source_note FROM n"""
    out["truncate_desc"] = "SELECT doc_id, substring(text, 1, 12000) AS shortened FROM documents"
    out["prompt_render"] = f"{S} SELECT ord, {ASK_SCORE} AS scoring_prompt, {ASK_PAY} AS estimate_prompt FROM sightings"
    out["run_stamp"] = f"""{S}, t AS (SELECT ord, seen_at + to_minutes(ord % 1440) AS day FROM sightings)
SELECT ord, concat(strftime(day, '%Y-%m-%d %H:%M'), ' UTC') AS stamp, strftime(day, '%Y-%m-%d') AS run_date FROM t"""
    out["defaults"] = f"""{S} SELECT ord, CASE WHEN location IS NULL OR location = '' THEN 'Not specified' ELSE location END AS location,
 CASE WHEN title = '' THEN 'Unknown title' ELSE title END AS title, CASE WHEN coalesce(salary_text, '') = '' THEN 'Not disclosed' ELSE salary_text END AS pay FROM sightings"""
    out["employer_label"] = f"""{VS}, p AS ({JSON_REPLY} verdicts)
SELECT ord, CASE {js('employer_type')} WHEN 'product' THEN 'Product/PaaS-SaaS' WHEN 'service' THEN 'Service-based' ELSE 'Unknown' END AS label FROM p"""

    out["posting_upsert"] = f"{ST} SELECT {POST}, is_new, sightings FROM up2"
    rescored = f"{ST}, touched AS (SELECT * EXCLUDE (is_new, sightings) FROM up2 WHERE is_new IS NOT NULL), old_only AS (SELECT * FROM st1 WHERE url_hash NOT IN (SELECT url_hash FROM touched)),\n"
    out["match_upsert"] = f"""{rescored}{scored('touched', 'a')},
{scored('old_only', 'b')} SELECT url_hash, {MATCH}, TIMESTAMP '{NOW2}' AS matched_at FROM a UNION ALL SELECT url_hash, {MATCH}, TIMESTAMP '{NOW1}' FROM b"""
    out["status_on_match"] = f"""{ST}, q AS (SELECT * FROM st2 WHERE url_hash NOT IN (SELECT url_hash FROM st1)),
{scored('q', 'sq')} SELECT p.url_hash, CASE WHEN sq.url_hash IS NULL THEN p.status WHEN sq.hard_filtered THEN 'skipped' ELSE 'matched' END AS status
FROM st2 p LEFT JOIN sq USING (url_hash)"""
    out["salary_upsert"] = f"""{BOTH} SELECT url_hash, {SAL}, TIMESTAMP '{NOW2}' AS enriched_at FROM sal2
UNION ALL SELECT url_hash, {SAL}, TIMESTAMP '{NOW1}' FROM sal1 WHERE url_hash NOT IN (SELECT url_hash FROM sal2)"""
    out["cache_upsert"] = f"""{RUN2} SELECT * FROM sal2_new UNION ALL SELECT cache_key, salary_display, salary_min_inr, salary_max_inr, looked_up_at FROM cache
WHERE cache_key NOT IN (SELECT cache_key FROM sal2_new)"""
    out["mark_queued"] = f"""{RUN2} SELECT url_hash, CASE WHEN url_hash IN (SELECT url_hash FROM todo2) THEN 'queued_for_review' ELSE status END AS status FROM ps2"""
    out["set_status"] = f"""{ST}, ch AS (SELECT sha256(concat('https://jobs.example.com/j/', c_custkey)) AS url_hash, CASE WHEN c_acctbal < 0 THEN 'rejected' ELSE 'applied' END AS new_status
 FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) SELECT url_hash, coalesce(new_status, status) AS status FROM st2 LEFT JOIN ch USING (url_hash)"""
    out["digest_block"] = f"{RUN2} SELECT url_hash, {BLOCK} AS block FROM rows2"
    out["digest_document"] = f"{RUN2},\n{DOCUMENT} SELECT section, part, score, url_hash, text FROM doc"
    last = ", ".join(REFRESHED)
    out["ingest_stream"] = f"""{S},
{LATEST},
{scored('latest', 'sc')} SELECT url_hash, url, source, {last}, CASE WHEN hard_filtered THEN 'skipped' ELSE 'matched' END AS status,
 TIMESTAMP '{NOW2}' AS first_seen_at, TIMESTAMP '{NOW2}' AS last_seen_at FROM sc"""
    out["scorer_plugin"] = f"""{ST}, sized AS (SELECT *, length({ASK_SCORE}) AS len FROM st2),
replied AS (SELECT * EXCLUDE (len), concat('{{"role_fit_score": ', len % 101, ', "reason": "length ', len, '", "is_technical_product_role": ', len % 7 <> 0, ', "employer_type": "',
 CASE WHEN len % 3 = 0 THEN 'service' ELSE 'product' END, '", "sponsorship_confidence": "likely", "sponsorship_evidence": null}}') AS reply FROM sized),
{verdict_ctes('replied', 'jd')} SELECT url_hash, {MATCH} FROM jd"""
    out["estimator_plugin"] = f"{KC},\n{priced('keyed', 'pr', NOW2, 'cache', estimator=True)} SELECT url_hash, ord, {SAL} FROM pr"
    return out

