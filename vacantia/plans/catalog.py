"""Registered queries: every operator of the library over the derived views."""
from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vacantia import params as P
from vacantia.functions import html_pages, report, rules, salary, text as X, variant as V
from vacantia.operators import dedup, enrich, plugins, ranking, upsert, verdicts
from vacantia.params import Params
from vacantia.plans.daily import score_queue, stage, ts, upsert_batch
from vacantia.plans.views import short_lived_shuffles, short_methods, spread, table, view
from vacantia.schema import CANONICAL, MATCHES, MATCH_COLUMNS, POSTINGS, SALARIES, SALARY_CACHE
from vacantia.sources import feeds, fx as FX, registry, state as S
from vacantia.sources.report_files import write_report
from vacantia.sources.workdir import work_dir
from vacantia.streaming.ingest import start_ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PARAMS = Params(**P.CUTS)   # the queries show the cuts; a run has none unless asked
ARRIVAL = ["seen_at", "ord"]
LANDED_PAGE = 20_000   # sightings a landed page spans
LANDED_AS = {"compression": "gzip", "zlib.compress.level": "THREE"}   # twice as fast as the default level
SPLIT_DAY = "1996-01-01 00:00:00"   # sightings before it are the first batch
FIRST_RUN = "1996-01-01 00:00:00"
SECOND_RUN = "2001-08-15 00:00:00"
FEED_COLUMNS = [c for c in CANONICAL if c != "raw"]
c = F.col


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---- shared frames ----------------------------------------------------------

def sightings(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "sightings")


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.with_key(feeds.valid(sightings(spark, sf)))


def latest(spark: SparkSession, sf: str) -> DataFrame:
    """One row per key over all sightings, as after a first run on them."""
    return dedup.collapse_batch(keyed(spark, sf), ARRIVAL).withColumn("ord", c("last_pos.ord")).drop("last_pos", "first_pos")


def scored_latest(spark: SparkSession, sf: str) -> DataFrame:
    return rules.score_postings(latest(spark, sf), PARAMS)


def passing(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.selected_matches(scored_latest(spark, sf), PARAMS)


def passing_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a written table: the few survivors, for jobs that read them twice."""
    return stage(passing(spark, sf), work_dir(spark, "passing"), 1, "passing")


def empty(spark: SparkSession, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows, split = sightings(spark, sf), F.to_timestamp_ntz(F.lit(SPLIT_DAY))
    return rows.filter(c("seen_at") < split), rows.filter(c("seen_at") >= split)


def state1(spark: SparkSession, sf: str) -> DataFrame:
    first, _ = batches(spark, sf)
    done = upsert.upsert_postings(empty(spark, POSTINGS), first, ts(FIRST_RUN), ARRIVAL)
    return done.drop("is_new", "sightings")


def upserted2(spark: SparkSession, sf: str, first: DataFrame | None = None) -> DataFrame:
    """``first``: what :func:`state1` gives, if the caller has it as a written table; so below."""
    _, second = batches(spark, sf)
    return upsert.upsert_postings(state1(spark, sf) if first is None else first, second, ts(SECOND_RUN), ARRIVAL)


def state2(spark: SparkSession, sf: str, first: DataFrame | None = None) -> DataFrame:
    return upserted2(spark, sf, first).drop("is_new", "sightings")


def matches1(spark: SparkSession, sf: str, first: DataFrame | None = None) -> DataFrame:
    return score_queue(state1(spark, sf) if first is None else first, empty(spark, MATCHES), ts(FIRST_RUN), PARAMS)


def static_fx(spark: SparkSession) -> DataFrame:
    return FX.read_fx(spark, None, PARAMS)


def run_state(spark: SparkSession, sf: str, which: int) -> dict[str, DataFrame]:
    """State after scoring and pricing everything of the first or of both batches.

    Built from written tables like a real run, so no query drags the whole lineage along.
    """
    root = work_dir(spark, "state")
    postings, now = (state1(spark, sf), ts(FIRST_RUN)) if which == 1 else (state2(spark, sf), ts(SECOND_RUN))
    postings = stage(postings, root, which, "postings")
    matches = stage(score_queue(postings, empty(spark, MATCHES), now, PARAMS), root, which, "matches")
    state = {
        "postings": upsert.status_on_match(postings, matches), "matches": matches,
        "salaries": empty(spark, SALARIES),
    }
    todo = ranking.report_rows(state, PARAMS).withColumn("ord", c("url_hash"))
    base = stage(enrich.price_base(todo, static_fx(spark)), root, which, "price_base")
    settled = stage(enrich.settle_keys(base, view(spark, sf, "cache"), now, PARAMS), root, which, "settled")
    state["salaries"] = enrich.priced_rows(base, settled).withColumn("enriched_at", now).select(*SALARIES.fieldNames())
    state["salary_lookup_cache"] = enrich.cache_rows(settled, now)
    return state


# ---- sources ----------------------------------------------------------------

def raw_records(spark: SparkSession, sf: str, feed: str) -> DataFrame:
    parsed = view(spark, sf, f"raw_{feed}").withColumn("rec", X.computed_once(F.try_parse_json("raw"))).drop("raw")
    return parsed.filter("rec IS NOT NULL")


def _source(spark: SparkSession, sf: str, feed: str) -> DataFrame:
    return feeds.normalise(raw_records(spark, sf, feed), feed).select("ord", *FEED_COLUMNS)


@query
def src_himalayas(spark, sf):
    return _source(spark, sf, "himalayas")


@query
def src_remoteok(spark, sf):
    recs = feeds.jobs_only(raw_records(spark, sf, "remoteok"))
    return feeds.normalise(recs, "remoteok").select("ord", *FEED_COLUMNS)


ANY_TITLE = PARAMS.with_(search_words=("",), per_source_cap=None, max_pages=None)


def _landed_page(ord_: str) -> Column:
    return F.floor(c(ord_) / LANDED_PAGE).cast("int")


def _by_page(orders: DataFrame) -> DataFrame:
    """Orders dealt by the page they land in, two pages or so to a task at any size of the table."""
    cores = orders.sparkSession.sparkContext.defaultParallelism
    return orders.repartition(max(2 * cores, orders.count() // (2 * LANDED_PAGE)), _landed_page("o_orderkey"))


def payload_texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """The payload files of a source, one row each.

    A file holds the records of one search and page, in order; records cut off while they were sent make a
    file of their own in JSON, and stand among the others in RSS. Orders meet by page before records are made
    of them, so no record is shuffled.
    """
    rows = view(spark, sf, f"raw_{name}" if name in feeds.RECORD_KEY else "raw_rss", _by_page).withColumn("page", _landed_page("ord"))
    if name in feeds.RECORD_KEY:
        key = feeds.RECORD_KEY[name]
        rows = rows.withColumn("part", F.when(F.try_parse_json("raw").isNull(), "cut").otherwise("whole"))
        head, gap, tail = ("[", ",", "]") if key is None else (f'{{"{key}":[', ",", "]}")
    else:
        rows = rows.withColumn("part", F.lit("whole")).withColumnRenamed("item_xml", "raw")
        head, gap, tail = "<rss><channel>", "\n", "</channel></rss>"
    files = rows.groupBy("keyword_ord", "page", "part").agg(F.array_sort(F.collect_list(F.struct("ord", "raw"))).alias("r"))
    text = F.concat(F.lit(head), F.array_join("r.raw", gap), F.lit(tail)).alias("value")
    return files.select("keyword_ord", "page", "part", text)


def landing(spark: SparkSession, sf: str, *names: str) -> str:
    """The raw records of sources written as their payload files, as a client would land them: compressed."""
    root = work_dir(spark, "landing")
    for name in names:
        with short_methods(spark), short_lived_shuffles(spark):
            payload_texts(spark, sf, name).write.partitionBy("keyword_ord", "page", "part").options(**LANDED_AS).text(f"{root}/{name}")
    return root


@query
def src_weworkremotely(spark, sf):
    items = feeds.parse_rss(view(spark, sf, "raw_rss"), "item_xml")
    return feeds.weworkremotely(items).select("ord", *FEED_COLUMNS)


@query
def landed_rss(spark, sf):
    path = f"{landing(spark, sf, 'weworkremotely')}/weworkremotely"
    rows = feeds.parsed(feeds.read_landed(spark, "weworkremotely", path), "weworkremotely", ANY_TITLE).filter("error IS NULL")
    place = F.row_number().over(Window.partitionBy("file").orderBy("pos"))
    return rows.select("keyword_ord", "page", place.alias("place"), *FEED_COLUMNS)


@query
def src_jsearch(spark, sf):
    return _source(spark, sf, "jsearch")


@query
def src_adzuna(spark, sf):
    return _source(spark, sf, "adzuna")


@query
def src_arbeitnow(spark, sf):
    return _source(spark, sf, "arbeitnow")


@query
def page_cutoff(spark, sf):
    run, page = F.floor(c("ord") / 500).cast("bigint"), (F.floor(c("ord") % 500 / 50) + 1).cast("int")
    rows = view(spark, sf, "raw_arbeitnow").select(run.alias("run"), page.alias("page"))
    blank = (c("run") % 5 == 0) & (c("page") == 2)
    last = F.when(c("run") % 3 == 0, 2).when(c("run") % 3 == 2, 5)
    pages = rows.groupBy("run", "page").agg(F.count_if(~blank).alias("n_jobs")).withColumn("last_page", last)
    return dedup.page_cutoff(pages, "run", PARAMS.max_pages)


@query
def union_sources(spark, sf):
    recs = {feed: raw_records(spark, sf, feed) for feed in feeds.NORMALISERS}
    recs["remoteok"] = feeds.jobs_only(recs["remoteok"])
    found = {feed: feeds.normalise(df, feed) for feed, df in recs.items()}
    found["weworkremotely"] = feeds.weworkremotely(feeds.parse_rss(view(spark, sf, "raw_rss"), "item_xml"))
    narrow = {name: df.select("ord", *FEED_COLUMNS) for name, df in found.items()}
    return registry.union_sources(narrow, PARAMS).select(
        "ord", c("source_ord").cast("int").alias("source_ord"), "source", "title", "company", "url", "remote_type")


@query
def landed_sources(spark, sf):
    found, _ = registry.ingest_sources(spark, landing(spark, sf, *ANY_TITLE.enabled_sources), ANY_TITLE)
    return found.select(c("source_ord").cast("int").alias("source_ord"), "source", "title", "company", "url", "remote_type")


@query
def quarantine(spark, sf):
    names = ("himalayas", "weworkremotely")
    _, rejects = registry.ingest_sources(spark, landing(spark, sf, *names), ANY_TITLE.with_(enabled_sources=names))
    asked = [F.regexp_extract("file", f"/{name}=([^/]+)/", 1).cast("int").alias(name) for name in ("keyword_ord", "page")]
    # the place of an RSS item is an offset, which only its order means
    return rejects.select("source", *asked, F.when(c("source") == "himalayas", c("pos")).alias("pos"), "error")


@query
def state_read(spark, sf):
    # both batches as runs upsert them, by bucket
    root = work_dir(spark, "state_read")
    for rows, now in zip(batches(spark, sf), (FIRST_RUN, SECOND_RUN)):
        new = S.Generation(spark, root)
        upsert_batch(new, rows, ARRIVAL, ts(now))
        new.commit(now)
    return S.read_state(spark, root)["postings"]


def _tables(spark: SparkSession, sf: str, first: DataFrame) -> dict[str, DataFrame]:
    return {
        "postings": first, "matches": matches1(spark, sf, first),
        "salaries": empty(spark, SALARIES), "salary_lookup_cache": view(spark, sf, "cache"),
    }


@query
def state_write(spark, sf):
    root, rows = work_dir(spark, "state_write"), work_dir(spark, "state_rows")
    # an upsert shuffles all sightings: each is made once, for the status, the content, the matches and the next upsert
    first = stage(state1(spark, sf), rows, 1, "postings")
    S.write_state(_tables(spark, sf, first), root, FIRST_RUN)
    second = stage(state2(spark, sf, first), rows, 2, "postings")
    S.write_state({"postings": second}, root, SECOND_RUN)   # the other tables keep their files
    current = S.read_state(spark, root)
    counts = [
        current[name].agg(F.count(F.lit(1)).alias("stored")).select(F.lit(name).alias("state_table"), "stored")
        for name in ("postings", "matches", "salaries", "salary_lookup_cache")
    ]
    generation = F.lit(S.current_generation(spark, root)).alias("generation")
    return counts[0].unionAll(counts[1]).unionAll(counts[2]).unionAll(counts[3]).select("*", generation)


@query
def fx_scan(spark, sf):
    parsed = FX.parse_fx(view(spark, sf, "fx_payloads"))
    inr = F.try_element_at("fx.rates", F.lit("INR"))
    return parsed.select("payload_id", F.size(F.map_keys("fx.rates")).alias("n_rates"), inr.alias("inr"),
                         c("fx.time_last_update_utc").alias("stamp"))


@query
def digest_sink(spark, sf):
    state = run_state(spark, sf, 2)
    root = work_dir(spark, "digest_sink")
    doc = ranking.document(ranking.report_rows(state, PARAMS), F.lit(P.FALLBACK_FX_LABEL), ts(SECOND_RUN))
    dated = write_report(doc, root, SECOND_RUN[:10])
    lines = spark.read.text(dated).select(F.lit("dated").alias("copy"), c("value").alias("line"))
    newest = spark.read.text(f"{root}/latest").select(F.lit("latest").alias("copy"), c("value").alias("line"))
    return lines.unionAll(newest)


# ---- projections, filters, classifiers --------------------------------------

@query
def canonical_projection(spark, sf):
    return feeds.to_canonical(sightings(spark, sf))


@query
def url_key(spark, sf):
    return sightings(spark, sf).select("ord", X.url_key(c("url")).alias("url_hash"))


@query
def valid_posting(spark, sf):
    return feeds.valid(sightings(spark, sf)).select("ord", "url", "title")


@query
def search_filter(spark, sf):
    return sightings(spark, sf).filter(X.matches_any(c("title"), PARAMS.search_words)).select("ord", "title")


@query
def employment_exclude(spark, sf):
    return sightings(spark, sf).select("ord", rules.employment_reason(c("employment_type"), PARAMS).alias("reason"))


@query
def keyword_exclude(spark, sf):
    lowered = F.lower(F.concat_ws(" ", "title", "description"))
    return sightings(spark, sf).select("ord", rules.keyword_reason(lowered, PARAMS).alias("reason"))


@query
def product_role_gate(spark, sf):
    words = sightings(spark, sf).select("ord", rules.role_text(c("title"), c("description"), PARAMS).alias("words"))
    return words.select("ord", rules.is_product_role(c("words"), PARAMS).alias("is_product_role"))


def _lowered(spark: SparkSession, sf: str) -> DataFrame:
    return sightings(spark, sf).withColumn("low", F.lower("description"))


@query
def marketing_gate(spark, sf):
    hits = _lowered(spark, sf).select(
        "ord", rules.marketing_hits(c("low"), PARAMS).alias("marketing"), rules.product_hits(c("low")).alias("product"))
    return hits.withColumn("reason", rules.marketing_reason(c("marketing"), c("product")))


@query
def seniority(spark, sf):
    dated = rules.with_years(sightings(spark, sf).select("ord", "title", "description"))
    return dated.select("ord", rules.seniority_of(c("title"), c("years"), PARAMS).alias("seniority"))


@query
def location_tier(spark, sf):
    return sightings(spark, sf).select(
        "ord", rules.location_tier(c("location"), c("remote_type"), PARAMS).alias("location_tier"))


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return _lowered(spark, sf).select(
        "ord", "title", "description",
        X.phrase_hits(c("low"), PARAMS.prioritised).alias("prioritised"),
        X.phrase_hits(c("low"), PARAMS.deprioritised).alias("deprioritised"),
        X.phrase_hits(c("low"), PARAMS.search_words).alias("search"),
    )


@query
def employer_type(spark, sf):
    return _hits(spark, sf).select(
        "ord", rules.employer_type(c("prioritised"), c("deprioritised")).alias("employer_type"))


@query
def sponsorship_evidence(spark, sf):
    return _lowered(spark, sf).select("ord", rules.sponsorship(c("low"), PARAMS).alias("s")).select("ord", "s.*")


@query
def sponsorship_gate(spark, sf):
    rows = _lowered(spark, sf).select(
        "ord", rules.location_tier(c("location"), c("remote_type"), PARAMS).alias("tier"),
        rules.sponsorship(c("low"), PARAMS)["confidence"].alias("confidence"))
    return rows.withColumn("reason", rules.sponsorship_reason(c("tier"), c("confidence"), PARAMS))


@query
def gate_ladder(spark, sf):
    return rules.score_postings(sightings(spark, sf), PARAMS).select(
        "ord", "hard_filtered", "hard_filter_reason", "location_tier", "employer_type",
        "sponsorship_confidence", "sponsorship_evidence")


def _scored_parts(spark: SparkSession, sf: str) -> DataFrame:
    hits = rules.with_years(_hits(spark, sf)).select(
        "ord", "title", (c("search") + c("prioritised")).alias("hits"),
        rules.seniority_of(c("title"), c("years"), PARAMS).alias("seniority"),
        rules.employer_type(c("prioritised"), c("deprioritised")).alias("employer"),
    )
    return hits.withColumn("raw_score", rules.raw_score(c("hits"), c("seniority"), c("title")))


@query
def role_fit_score(spark, sf):
    return _scored_parts(spark, sf).select("ord", "hits", "raw_score")


@query
def employer_penalty(spark, sf):
    weighted = rules.employer_penalty(c("raw_score"), c("employer"), PARAMS)
    return _scored_parts(spark, sf).select("ord", "employer", weighted.alias("weighted_score"))


@query
def match_reason(spark, sf):
    return _scored_parts(spark, sf).select(
        "ord", rules.match_reason(c("hits"), c("seniority"), c("employer")).alias("match_reason"))


@query
def score_postings(spark, sf):
    return scored_latest(spark, sf).select("url_hash", *MATCH_COLUMNS)


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    replies = view(spark, sf, "verdicts").select("ord", "reply")
    return verdicts.apply_verdicts(sightings(spark, sf).join(replies, "ord"), PARAMS)


@query
def verdict_gates(spark, sf):
    return _judged(spark, sf).filter(~c("failed")).select("ord", *MATCH_COLUMNS)


@query
def digest_select(spark, sf):
    state = run_state(spark, sf, 2)
    return ranking.report_rows(state, PARAMS).select("url_hash", "role_fit_score", "status")


@query
def needs_salary(spark, sf):
    # postings of both batches against the salaries of the first run only
    state = run_state(spark, sf, 2) | {"salaries": run_state(spark, sf, 1)["salaries"]}
    return ranking.needs_salary(ranking.report_rows(state, PARAMS)).select("url_hash", "title")


# ---- joins --------------------------------------------------------------------

@query
def match_queue(spark, sf):
    return upsert.match_queue(state2(spark, sf), matches1(spark, sf)).select("url_hash", "title", "status")


@query
def digest_join(spark, sf):
    state = run_state(spark, sf, 2) | {"salaries": run_state(spark, sf, 1)["salaries"]}
    return ranking.report_join(state["postings"], state["matches"], state["salaries"]).select(
        "url_hash", "url", "status", "hard_filtered", "role_fit_score", "match_reason", "salary_display")


@query
def existing_keys(spark, sf):
    return upsert.existing_keys(batches(spark, sf)[1], state1(spark, sf))


@query
def ttl_lookup(spark, sf):
    keys = feeds.valid(sightings(spark, sf)).select(X.cache_key(c("company"), c("title"), c("location")).alias("cache_key"))
    return enrich.ttl_lookup(keys.distinct(), view(spark, sf, "cache"), ts(SECOND_RUN), PARAMS.cache_ttl_days)


def _parsed_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return salary.with_range(sightings(spark, sf).select("ord", "description"), "description", "s").select("ord", "s.*")


@query
def fx_join(spark, sf):
    rates = static_fx(spark).select("currency", "rate_to_inr")
    return _parsed_ranges(spark, sf).join(F.broadcast(rates), "currency").select("ord", "currency", "rate_to_inr")


@query
def page_fallback(spark, sf):
    pages = spread(table(spark, sf, "pages").select("url", "html"))
    teasers = pages.select("url", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("description"))
    return feeds.with_page_text(teasers, html_pages.main_text(pages), PARAMS).select("url", "description")


@query
def verdict_join(spark, sf):
    replies = view(spark, sf, "verdicts").select("ord", "reply")
    judged = verdicts.apply_verdicts(latest(spark, sf).join(replies, "ord", "left"), PARAMS)
    return judged.select("url_hash", F.when(c("failed"), "queued").otherwise("saved").alias("outcome"))


@query
def posting_lookup(spark, sf):
    wanted = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    url = F.concat(F.lit("https://jobs.example.com/j/"), c("c_custkey"))
    keys = wanted.select(X.url_key(url).alias("url_hash"))
    root = work_dir(spark, "posting_lookup")
    S.write_state({"postings": state2(spark, sf)}, root, SECOND_RUN)
    return S.lookup(S.snapshot(spark, root), keys).select("url_hash", "url", "title", "status")


# ---- aggregations -------------------------------------------------------------

@query
def phrase_hits(spark, sf):
    return _hits(spark, sf).select("ord", "prioritised", "deprioritised", "search")


@query
def ingest_totals(spark, sf):
    return registry.ingest_totals(sightings(spark, sf))


@query
def dedup_totals(spark, sf):
    return upsert.dedup_totals(upserted2(spark, sf))


@query
def match_totals(spark, sf):
    queue = upsert.match_queue(state2(spark, sf), matches1(spark, sf))
    return verdicts.match_totals(queue, rules.score_postings(queue, PARAMS))


@query
def digest_totals(spark, sf):
    return ranking.report_totals(passing(spark, sf))


@query
def distinct_url_first(spark, sf):
    rows = sightings(spark, sf).select("url", "ord", (c("ord") % 4).cast("int").alias("keyword_ord"), "title", "source")
    return dedup.distinct_first(rows, ["url"], ["keyword_ord", "ord"]).withColumn("keyword_ord", c("keyword_ord").cast("bigint"))


@query
def distinct_url_last(spark, sf):
    rows = sightings(spark, sf).select("url", "ord", "title", "source")
    return dedup.distinct_last(rows, "url", ["ord"])


# ---- windows ------------------------------------------------------------------

@query
def source_cap(spark, sf):
    found = sightings(spark, sf).filter(X.matches_any(c("title"), PARAMS.search_words))
    return dedup.cap_per_group(found.select("ord", "seen_at", "source", "title"), PARAMS.per_source_cap, "source", ARRIVAL)


@query
def keyword_round_cap(spark, sf):
    rows = sightings(spark, sf).select("ord", "url", "source", "title", F.floor(c("ord") / 20).alias("round"))
    both = [
        dedup.cap_by_round(rows, PARAMS.per_source_cap, "source", "url", "round", "ord", keep)
        .select(F.lit(keep).alias("keep"), "source", "url", "ord", "title", "first_pos.p")
        for keep in ("first", "last")
    ]
    return both[0].unionAll(both[1]).withColumnRenamed("p", "first_ord")


@query
def batch_collapse(spark, sf):
    return dedup.collapse_batch(keyed(spark, sf), ARRIVAL).select(
        "url_hash", "url", "source", *upsert.REFRESHED, c("first_pos.ord").alias("first_ord"),
        c("last_pos.ord").alias("last_ord"), "sightings")


@query
def failure_cutoff(spark, sf):
    rows = view(spark, sf, "verdicts").select("ord", "batch", V.first_object(c("reply")).isNull().alias("failed"))
    return verdicts.cut_after_failures(rows, "batch", "ord", "failed", PARAMS.max_failures_in_row)


def _price_base(spark: SparkSession, sf: str) -> DataFrame:
    """Every storable sighting with its stated salary, as a written table (it is read three times)."""
    rows = keyed(spark, sf).select(
        "ord", "url_hash", "title", "company", "location", "remote_type", "description", "salary_text")
    return stage(enrich.price_base(rows, static_fx(spark)).drop("description"), work_dir(spark, "price"), 1, "base")


@query
def run_cache_reuse(spark, sf):
    base = _price_base(spark, sf)
    settled = enrich.settle_keys(base, empty(spark, SALARY_CACHE), ts(SECOND_RUN), PARAMS)
    reused = F.coalesce(c("source_note") == P.CACHED_NOTE, F.lit(False))
    return enrich.priced_rows(base, settled).select("ord", "salary_display", reused.alias("reused"))


@query
def tier_rank(spark, sf):
    return ranking.tier_rank(passing_table(spark, sf)).select("location_tier", "rank", "role_fit_score", "url_hash")


@query
def digest_order(spark, sf):
    return ranking.ordered(passing(spark, sf)).select("location_tier", "role_fit_score", "url_hash", "title")


# ---- scalar functions -----------------------------------------------------------

@query
def html_strip(spark, sf):
    return spread(table(spark, sf, "pages").select("page_id", "html")).select("page_id", X.strip_html(c("html")).alias("body"))


@query
def html_main_text(spark, sf):
    return html_pages.main_text(spread(table(spark, sf, "pages").select("page_id", "html")))


@query
def title_split(spark, sf):
    full = F.when(c("ord") % 6 == 0, c("title")).otherwise(
        F.concat(F.lit(" "), c("company"), F.lit(": "), c("title"), F.lit(": Remote ")))
    return sightings(spark, sf).select("ord", X.split_title(full).alias("s")).select("ord", "s.*")


@query
def years_range(spark, sf):
    return rules.with_years(sightings(spark, sf).select("ord", "description")).select("ord", "years.*")


@query
def salary_lpa(spark, sf):
    both = sightings(spark, sf).select("ord", F.concat_ws(" ", "salary_text", "description").alias("both"))
    return salary.with_lpa(both, "both", "s").select(
        "ord", (c("s.low") * salary.LAKH).alias("min_inr"), (c("s.high") * salary.LAKH).alias("max_inr"))


@query
def salary_range(spark, sf):
    return _parsed_ranges(spark, sf)


def _stated(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.with_stated(sightings(spark, sf).select("ord", "salary_text", "description"), static_fx(spark))


@query
def salary_stated(spark, sf):
    return _stated(spark, sf).select("ord", "stated.*")


@query
def fx_convert(spark, sf):
    rates = static_fx(spark).select("currency", "rate_to_inr")
    return _parsed_ranges(spark, sf).join(rates, "currency").select(
        "ord", "currency", (c("low") * c("rate_to_inr")).alias("min_inr"), (c("high") * c("rate_to_inr")).alias("max_inr"))


@query
def fx_cross_rates(spark, sf):
    payloads = FX.parse_fx(view(spark, sf, "fx_payloads"))
    rates, label = FX.cross_rates(c("fx"), PARAMS)
    return payloads.select("payload_id", *[rates[k].alias(k.lower()) for k in FX.CURRENCIES], label.alias("label"))


@query
def salary_display(spark, sf):
    return _stated(spark, sf).filter("stated IS NOT NULL").select(
        "ord", enrich.stated_display(c("stated")).alias("salary_display"))


@query
def cache_key(spark, sf):
    padded = F.concat(F.lit(" \t"), c("company"), F.lit("  Ltd \n"))
    return sightings(spark, sf).select("ord", X.cache_key(padded, c("title"), c("location")).alias("cache_key"))


@query
def salary_cascade(spark, sf):
    base = _price_base(spark, sf)
    settled = enrich.settle_keys(base, view(spark, sf, "cache"), ts(SECOND_RUN), PARAMS)
    return enrich.priced_rows(base, settled)


@query
def noisy_json(spark, sf):
    rows = view(spark, sf, "verdicts").select("ord", V.first_object(c("reply")).alias("v"))
    score = F.try_variant_get("v", "$.role_fit_score", "string")
    return rows.select("ord", c("v").isNotNull().alias("found"), score.alias("score_text"))


@query
def verdict_fields(spark, sf):
    found = X.computed_once(V.first_object(c("reply")))
    rows = view(spark, sf, "verdicts").select("ord", found.alias("v")).filter("v IS NOT NULL")
    read, fields = V.with_fields(rows, "v", verdicts.VERDICT_KEYS)
    return read.select("ord", *[col.alias(name) for name, col in verdicts.verdict_fields(fields).items()])


@query
def estimate_parse(spark, sf):
    return plugins.parse_estimates(view(spark, sf, "estimate_replies"))


@query
def truncate_desc(spark, sf):
    return table(spark, sf, "documents").select("doc_id", plugins.truncate_description(c("text"), PARAMS).alias("shortened"))


@query
def prompt_render(spark, sf):
    return sightings(spark, sf).select(
        "ord", plugins.scoring_prompt(PARAMS).alias("scoring_prompt"), plugins.estimate_prompt().alias("estimate_prompt"))


@query
def run_stamp(spark, sf):
    at = c("seen_at") + F.expr("make_dt_interval(0, 0, CAST(ord % 1440 AS INT))")
    return sightings(spark, sf).select(
        "ord", report.run_stamp(at).alias("stamp"), report.run_date(at).alias("run_date"))


@query
def defaults(spark, sf):
    return sightings(spark, sf).select(
        "ord", X.or_default(c("location"), "Not specified").alias("location"),
        X.or_default(c("title"), "Unknown title").alias("title"), X.or_default(c("salary_text"), P.NOT_DISCLOSED).alias("pay"))


@query
def employer_label_(spark, sf):
    v = V.first_object(c("reply"))
    return view(spark, sf, "verdicts").select("ord", report.employer_label(F.try_variant_get(v, "$.employer_type", "string")).alias("label"))


QUERIES["employer_label"] = QUERIES.pop("employer_label_")


# ---- upserts and status ---------------------------------------------------------

@query
def posting_upsert(spark, sf):
    return upserted2(spark, sf)


def staged_batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Postings after the first batch, and upserted with the second: written tables, as between two runs."""
    root = work_dir(spark, "batches")
    first = stage(state1(spark, sf), root, 1, "postings")
    second = upsert.upsert_postings(first, batches(spark, sf)[1], ts(SECOND_RUN), ARRIVAL)
    return first, stage(second, root, 2, "upserted")


@query
def match_upsert(spark, sf):
    # scored anew: every posting that the second batch touched
    first, second = staged_batches(spark, sf)
    touched = second.filter("is_new IS NOT NULL").drop("is_new", "sightings")
    old = score_queue(first, empty(spark, MATCHES), ts(FIRST_RUN), PARAMS)
    return upsert.upsert_by_key(old, score_queue(touched, empty(spark, MATCHES), ts(SECOND_RUN), PARAMS), "url_hash")


@query
def status_on_match(spark, sf):
    first, second = staged_batches(spark, sf)
    postings = second.drop("is_new", "sightings")
    old = score_queue(first, empty(spark, MATCHES), ts(FIRST_RUN), PARAMS)
    new = score_queue(postings, old, ts(SECOND_RUN), PARAMS)
    return upsert.status_on_match(postings.select("url_hash", "status"), new)


@query
def salary_upsert(spark, sf):
    return upsert.upsert_by_key(run_state(spark, sf, 1)["salaries"], run_state(spark, sf, 2)["salaries"], "url_hash")


@query
def cache_upsert(spark, sf):
    return upsert.upsert_by_key(view(spark, sf, "cache"), run_state(spark, sf, 2)["salary_lookup_cache"], "cache_key")


@query
def mark_queued(spark, sf):
    state = run_state(spark, sf, 2)
    return upsert.mark_queued(state["postings"].select("url_hash", "status"), ranking.report_rows(state, PARAMS))


@query
def set_status(spark, sf):
    # the outcome of a review: customers with a negative balance reject, the others apply
    people = table(spark, sf, "customer").filter("c_mktsegment IN ('BUILDING', 'MACHINERY')")
    url = F.concat(F.lit("https://jobs.example.com/j/"), c("c_custkey"))
    changes = people.select(
        X.url_key(url).alias("url_hash"), F.when(c("c_acctbal") < 0, "rejected").otherwise("applied").alias("status"))
    return upsert.set_status(state2(spark, sf).select("url_hash", "status"), changes)


# ---- report -----------------------------------------------------------------------

@query
def digest_block(spark, sf):
    return ranking.blocks(ranking.report_rows(run_state(spark, sf, 2), PARAMS)).select("url_hash", "block")


@query
def digest_document(spark, sf):
    rows = ranking.report_rows(run_state(spark, sf, 2), PARAMS)
    return ranking.document(rows, F.lit(P.FALLBACK_FX_LABEL), ts(SECOND_RUN))


# ---- streaming and plug-ins ---------------------------------------------------------

@query
def ingest_stream(spark, sf):
    root = work_dir(spark, "ingest_stream")
    landed = sightings(spark, sf)
    landed.write.parquet(f"{root}/landed")
    stream = spark.readStream.schema(landed.schema).parquet(f"{root}/landed")
    start_ingest(spark, stream, ARRIVAL, f"{root}/state", f"{root}/checkpoint", SECOND_RUN, PARAMS).awaitTermination()
    return S.read_state(spark, f"{root}/state")["postings"]


def stub_scorer(prompts: Sequence[str]) -> list[str]:
    """Stands in for a model: the verdict depends on the prompt's length only."""
    return ["Sure: " + json.dumps({
        "role_fit_score": len(p) % 101, "reason": f"length {len(p)}", "is_technical_product_role": len(p) % 7 != 0,
        "employer_type": "service" if len(p) % 3 == 0 else "product", "sponsorship_confidence": "likely",
        "sponsorship_evidence": None,
    }) for p in prompts]


def stub_estimator(prompts: Sequence[str]) -> list[str]:
    return ['{"min_lpa": %s, "max_lpa": %d, "basis": "length"}' % (
        "null" if len(p) % 4 == 0 else str(len(p) % 20), 20 + len(p) % 10) for p in prompts]


@query
def scorer_plugin(spark, sf):
    scored = plugins.score(state2(spark, sf), PARAMS.with_(mode="llm", max_failures_in_row=None), stub_scorer)
    return scored.select("url_hash", *MATCH_COLUMNS)


@query
def estimator_plugin(spark, sf):
    base = _price_base(spark, sf)
    settled = enrich.settle_keys(base, view(spark, sf, "cache"), ts(SECOND_RUN), PARAMS, stub_estimator)
    return enrich.priced_rows(base, settled)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Which postings pass all gates, scored and ranked within their tier."""
    return ranking.tier_rank(passing_table(spark, sf)).select(
        "location_tier", "rank", "role_fit_score", "url_hash", "title", "company", "location", "match_reason",
        "employer_type", "sponsorship_confidence", "sponsorship_evidence")
