"""JSON feeds: landed API payloads -> records -> canonical postings.

A payload is one response body in one file. Files may sit in partition folders
``country=``, ``keyword_ord=`` and ``page=`` that say which request they answer.
Records stay VARIANT until a normaliser reads them, because feeds drop, add and
null fields at will.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from vacantia import params as P
from vacantia.functions import variant as V
from vacantia.functions.text import computed_once, matches_any, or_default, split_title, strip, strip_html, text_or_empty
from vacantia.params import Params
from vacantia.schema import CANONICAL, CANONICAL_FIELDS
from vacantia.sources.payload_files import PayloadSource

# --- Fixed values: the key under which each feed keeps its records (None: the whole is the list), default URLs ---
RECORD_KEY = {
    "himalayas": "jobs",
    "remoteok": None,
    "jsearch": "data",
    "adzuna": "results",
    "arbeitnow": "data",
}
HIMALAYAS_URL = "https://himalayas.app/jobs/"
REMOTEOK_URL = "https://remoteok.com/remote-jobs/"
ADZUNA_COUNTRIES = ("in", "gb", "us")
# --- end of fixed values ---

_PARTITIONS = {"country": "string", "keyword_ord": "int", "page": "int"}
#: What a landed file or record gives, beside the canonical columns: where it lay, and why it can't be used.
ARRIVED = ["file", *_PARTITIONS, "pos"]


def _requested(df: DataFrame) -> DataFrame:
    """The request columns a file's path names; NULL if it doesn't."""
    for name, dtype in _PARTITIONS.items():
        found = F.nullif(F.regexp_extract("file", f"/{name}=([^/]+)/", 1), F.lit(""))
        df = df.withColumn(name, found.cast(dtype))
    return df


def read_payloads(spark: SparkSession, path: str | list[str], streaming: bool = False) -> DataFrame:
    """One row per landed file: text, path, and the request columns (NULL if not in the path)."""
    reader = spark.readStream if streaming else spark.read
    files = reader.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    return _requested(files.load(path).select("value", F.col("_metadata.file_path").alias("file")))


def read_items(spark: SparkSession, path: str | list[str], streaming: bool = False) -> DataFrame:
    """One row per piece of a landed RSS file that ends with an item, with the offset its split begins at.

    The text is cut at the end tags while it is read, so a file of any size is read by many tasks.
    """
    reader = spark.readStream if streaming else spark.read
    pieces = reader.format("text").option("lineSep", "</item>").option("recursiveFileLookup", True).load(path)
    return _requested(pieces.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")))


def read_records(spark: SparkSession, feed: str, path: str) -> DataFrame:
    """One row per record of landed JSON files (file, pos, value), or per file that can't be used (error).

    For payloads of any size: a file is walked by one task that holds one record at a time, where
    :func:`read_payloads` makes it a row. Needs a store that Python can open (local or shared paths, S3, GCS).
    """
    spark.dataSource.register(PayloadSource)
    found = spark.read.format("payload_records").option("key", RECORD_KEY[feed] or "").load(path)
    return _requested(found)


def read_landed(spark: SparkSession, feed: str, path: str | list[str], streaming: bool = False) -> DataFrame:
    return (read_payloads if feed in RECORD_KEY else read_items)(spark, path, streaming)


def _items_of(value: str, feed: str) -> Column:
    """The records of a payload, one VARIANT each; NULL if there is no record list. The text is parsed once,
    record by record: only a single record, not a whole file, has to fit in a VARIANT."""
    key = RECORD_KEY[feed]
    if key is None:
        return F.from_json(value, "array<variant>")
    return F.from_json(value, f"{key} array<variant>")[key]


def _payload_error(value: str) -> Column:
    # valid JSON without the record list (an error page, a changed envelope) isn't called invalid
    return F.when(F.get_json_object(value, "$").isNull(), "invalid JSON").otherwise("no readable record list")


def split_payloads(payloads: DataFrame, feed: str) -> tuple[DataFrame, DataFrame]:
    """Read the records of ``value`` into ``items``; set payloads without records aside with an error."""
    parsed = payloads.withColumn("items", computed_once(_items_of("value", feed)))
    good = parsed.filter("items IS NOT NULL").drop("value")
    return good, parsed.filter("items IS NULL").drop("items").withColumn("error", _payload_error("value"))


def records(payloads: DataFrame, feed: str) -> DataFrame:
    """Explode read payloads into one VARIANT ``rec`` per record with its position."""
    kept = [c for c in payloads.columns if c != "items"]
    return payloads.select(*kept, F.posexplode("items").alias("pos", "rec"))


def parsed(landed: DataFrame, feed: str, params: Params) -> DataFrame:
    """What was landed, in one pass: the arrival and canonical columns of every record that the searches
    want, and ``error`` for a record, or a file as a whole (without a position), that can't be used."""
    return parsed_items(landed, params) if feed not in RECORD_KEY else parsed_payloads(landed, feed, params)


def parsed_payloads(payloads: DataFrame, feed: str, params: Params) -> DataFrame:
    if "pos" in payloads.columns:  # record by record already
        rec = computed_once(F.try_parse_json("value"))
        recs = payloads.withColumn("rec", rec).drop("value").withColumn(
            "error", F.coalesce("error", F.when(F.col("rec").isNull(), "unreadable record")))
        return _settled_records(recs, feed, params)
    read = payloads.withColumn("items", computed_once(_items_of("value", feed)))
    read = read.withColumn("error", F.when(F.col("items").isNull(), _payload_error("value")))
    kept = [c for c in payloads.columns if c != "value"]
    recs = read.select(*kept, "error", F.posexplode_outer("items").alias("pos", "rec")).filter("error IS NOT NULL OR pos IS NOT NULL")
    return _settled_records(recs, feed, params)


def _settled_records(recs: DataFrame, feed: str, params: Params) -> DataFrame:
    recs = searched(recs, feed, params, keep=F.col("error").isNotNull())
    return normalise(recs, feed).withColumn("error", F.coalesce("error", _incomplete())).select(*ARRIVED, *CANONICAL, "error")


def parsed_items(pieces: DataFrame, params: Params) -> DataFrame:
    """A piece is one item and what stands before it. An item that isn't closed before the next one
    begins, or before the channel ends, is unreadable.

    Items take at least as many bytes as they count, so the offset of a split plus the number of the
    piece within its task orders the items of a file, however it was split.
    """
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    parts = pieces.withColumn("pos", F.col("start") + row).select(
        "file", *_PARTITIONS, "pos", computed_once(F.split("value", r"(?=<item[\s>/])")).alias("parts"))
    cut = parts.select("*", F.posexplode("parts").alias("n", "part")).filter(F.col("part").startswith("<item"))
    closed = (F.col("n") == F.size("parts") - 1) & ~F.col("part").contains("</channel>")
    items = parse_rss(cut.withColumn("xml", F.when(closed, F.concat("part", F.lit("</item>")))), "xml").drop("parts", "n", "part")
    broken = F.col("item").isNull() | F.col("item._corrupt_record").isNotNull()
    items = items.withColumn("error", F.when(broken, "unreadable RSS item"))
    wanted = searched_rss(items, params, keep=F.col("error").isNotNull())
    return weworkremotely(wanted, every=True).withColumn("error", F.coalesce("error", _incomplete())).select(*ARRIVED, *CANONICAL, "error")


# ---- normalisers: fields of a record -> canonical columns -------------------

def _salary(low: Column, high: Column, currency: Column, period: Column) -> Column:
    return strip(F.concat(currency, F.lit(" "), low, F.lit("-"), high, F.lit(" "), period))


def himalayas(f: dict[str, V.Field]) -> dict[str, Column]:
    stated = f["minSalary"].truthy() | f["maxSalary"].truthy()
    places = F.concat_ws(", ", V.array(F.col("rec"), "locationRestrictions", "string"))
    restricted = f["locationRestrictions"].truthy()
    open_wording = F.rlike(places, F.lit("(?i)worldwide|india"))
    return {
        "title": strip(f["title"].get()),
        "company": strip(f["companyName"].get()),
        "location": F.when(restricted, places).otherwise(P.ANYWHERE),
        "description": F.coalesce(f["description"].if_truthy(), f["excerpt"].if_truthy(), F.lit("")),
        "url": F.coalesce(f["applicationLink"].if_truthy(), F.concat(F.lit(HIMALAYAS_URL), f["guid"].shown())),
        "source": F.lit("himalayas"),
        "posted_date": f["pubDate"].text,
        "remote_type": F.when(~restricted | open_wording, "remote"),
        "employment_type": f["employmentType"].text,
        "salary_text": F.when(stated, _salary(
            f["minSalary"].shown_if_truthy(), f["maxSalary"].shown_if_truthy(),
            f["currency"].shown_if_truthy(), f["salaryPeriod"].shown_if_truthy(),
        )),
    }


def remoteok(f: dict[str, V.Field]) -> dict[str, Column]:
    stated = f["salary_min"].truthy() | f["salary_max"].truthy()
    job_id = F.coalesce(f["id"].if_truthy(), f["slug"].if_truthy())
    return {
        "title": strip(text_or_empty(f["position"].if_truthy())),
        "company": strip(text_or_empty(f["company"].if_truthy())),
        "location": F.coalesce(f["location"].if_truthy(), F.lit(P.ANYWHERE)),
        "description": strip_html(f["description"].text),
        "url": F.coalesce(f["url"].if_truthy(), F.concat(F.lit(REMOTEOK_URL), job_id), F.lit("")),
        "source": F.lit("remoteok"),
        "posted_date": f["date"].text,
        "remote_type": F.lit("remote"),
        "salary_text": F.when(stated, F.concat(
            F.lit("$"), f["salary_min"].shown_if_truthy(), F.lit("-"), f["salary_max"].shown_if_truthy(),
        )),
    }


def jsearch(f: dict[str, V.Field]) -> dict[str, Column]:
    stated = f["job_min_salary"].truthy() | f["job_max_salary"].truthy()
    place = F.concat_ws(", ", f["job_city"].if_truthy(), f["job_country"].if_truthy())
    return {
        "title": f["job_title"].get(),
        "company": f["employer_name"].get(),
        "location": or_default(place, "Not specified"),
        "description": f["job_description"].get(),
        "url": f["job_apply_link"].get(),
        "source": F.lit("jsearch"),
        "posted_date": f["job_posted_at_datetime_utc"].text,
        "remote_type": F.when(f["job_is_remote"].truthy(), "remote"),
        "employment_type": f["job_employment_type"].text,
        "salary_text": F.when(stated, _salary(
            f["job_min_salary"].shown(), f["job_max_salary"].shown(),
            f["job_salary_currency"].shown(), f["job_salary_period"].shown(),
        )),
    }


def adzuna(f: dict[str, V.Field]) -> dict[str, Column]:
    country = F.col("country")
    stated = f["salary_min"].truthy() | f["salary_max"].truthy()
    place = F.when(f["location"].truthy(), f["location.display_name"].text)
    company_given = f["company"].truthy() & ~f["company.display_name"].missing
    return {
        "title": f["title"].get(),
        "company": F.when(company_given, f["company.display_name"].text).otherwise(""),
        "location": or_default(place, F.upper(country)),
        "description": f["description"].get(),
        "url": f["redirect_url"].get(),
        "source": F.concat(F.lit("adzuna_"), country),
        "posted_date": f["created"].text,
        "employment_type": F.when(f["contract_type"].truthy(), f["contract_type"].text).otherwise(f["contract_time"].text),
        "salary_text": F.when(stated, F.concat(f["salary_min"].shown(), F.lit("-"), f["salary_max"].shown())),
    }


def arbeitnow(f: dict[str, V.Field]) -> dict[str, Column]:
    return {
        "title": f["title"].get(),
        "company": f["company_name"].get(),
        "location": F.coalesce(f["location"].if_truthy(), F.lit("Europe")),
        "description": strip_html(f["description"].text),
        "url": f["url"].get(),
        "source": F.lit("arbeitnow"),
        "posted_date": f["created_at"].if_truthy(),
        "visa_sponsorship": F.when(f["visa_sponsorship"].kind == "BOOLEAN", f["visa_sponsorship"].text == "true"),
        "remote_type": F.when(f["remote"].truthy(), "remote").otherwise("onsite"),
        "employment_type": F.try_element_at(V.array(F.col("rec"), "job_types", "string"), F.lit(1)),
    }


class _Asked(dict):
    """Notes which keys a normaliser asks for, so that just those are extracted."""

    def __missing__(self, key: str) -> V.Field:
        self[key] = V.Field(F.lit(""), F.lit(""))
        return self[key]


NORMALISERS: dict[str, Callable[[dict[str, V.Field]], dict[str, Column]]] = {
    "himalayas": himalayas, "remoteok": remoteok, "jsearch": jsearch, "adzuna": adzuna, "arbeitnow": arbeitnow,
}


def canonical(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Project to the 12 canonical columns; what a source lacks is a typed NULL."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in CANONICAL]
    fields = [
        (computed_once(columns[name]) if name in columns else F.lit(None)).cast(dtype).alias(name)
        for name, dtype in CANONICAL_FIELDS
    ]
    return df.select(*kept, *fields)


def to_canonical(df: DataFrame) -> DataFrame:
    """Rebuild canonical rows from any frame that has (some of) the columns, e.g. a state row."""
    have = {name: F.col(name) for name in CANONICAL if name in df.columns}
    have["description"] = text_or_empty(F.col("description"))
    return canonical(df, have, keep=[])


def normalise(recs: DataFrame, feed: str) -> DataFrame:
    """Canonical columns of every record, beside the position columns it came with."""
    asked = _Asked()
    NORMALISERS[feed](asked)
    read, fields = V.with_fields(recs, "rec", list(asked))
    columns = NORMALISERS[feed](fields) | {"raw": F.to_json("rec")}
    return canonical(read, columns, keep=[c for c in recs.columns if c != "rec"])


def jobs_only(recs: DataFrame, keep: Column | None = None) -> DataFrame:
    """RemoteOK only: drop the leading notice and entries without a position."""
    read, f = V.with_fields(recs, "rec", ["legal", "position"])
    return read.filter(_or_kept(f["legal"].missing & f["position"].truthy(), keep)).select(*recs.columns)


def _or_kept(wanted: Column, keep: Column | None) -> Column:
    return wanted if keep is None else keep | wanted


def searched(recs: DataFrame, feed: str, params: Params, keep: Column | None = None) -> DataFrame:
    """Client-side keyword search for the feeds that cannot search themselves; rows to ``keep`` stay anyway."""
    rec = F.col("rec")
    if feed == "remoteok":
        tags = F.concat_ws(" ", V.array(rec, "tags", "string"))
        wanted = F.concat_ws(" ", text_or_empty(F.try_variant_get(rec, "$.position", "string")), tags)
        return jobs_only(recs, keep).filter(_or_kept(matches_any(wanted, params.search_words), keep))
    if feed == "arbeitnow":
        return recs.filter(_or_kept(matches_any(F.try_variant_get(rec, "$.title", "string"), params.search_words), keep))
    return recs


def _incomplete() -> Column:
    return F.when(F.col("title").isNull(), "title is null").when(F.col("company").isNull(), "company is null")


def split_bad(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set aside records that lack a required field, each with its error; keep the rest."""
    marked = postings.withColumn("error", _incomplete())
    return marked.filter("error IS NULL").drop("error"), marked.filter("error IS NOT NULL")


def valid(postings: DataFrame) -> DataFrame:
    """Only rows with a URL and a title can be stored."""
    return postings.filter("url <> '' AND title <> ''")


RSS_ITEM = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("title", "link", "summary", "description", "pubDate", "_corrupt_record")
])


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """RSS items of landed feed files as a struct column ``item``."""
    xml = spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").schema(RSS_ITEM)
    return xml.load(path).select(F.struct("*").alias("item"))


def parse_rss(df: DataFrame, text: str) -> DataFrame:
    """The same from a column holding one ``<item>`` element per row, which is parsed once however the items are filtered."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return df.withColumn("item", computed_once(F.from_xml(text, RSS_ITEM.simpleString(), options))).drop(text)


def split_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Set aside RSS items that can't be read, each with its text and an error; keep the rest."""
    broken = F.col("item").isNull() | F.col("item._corrupt_record").isNotNull()
    bad = items.filter(broken).withColumn("error", F.lit("unreadable RSS item"))
    return items.filter(~broken), bad


def weworkremotely(items: DataFrame, every: bool = False) -> DataFrame:
    """Canonical postings of readable RSS items (see :func:`split_items`), or of every one. The title reads "Company: Title"."""
    item = F.col("item")
    split = items.withColumn("_split", split_title(item["title"]))
    columns = {
        "title": F.col("_split.title"),
        "company": F.col("_split.company"),
        "location": F.lit(P.ANYWHERE),
        "description": strip_html(or_default(item["summary"], item["description"])),
        "url": text_or_empty(item["link"]),
        "source": F.lit("weworkremotely"),
        "posted_date": item["pubDate"],
        "remote_type": F.lit("remote"),
        "raw": F.to_json(item),
    }
    kept = [c for c in items.columns if c != "item"]
    return canonical(split if every else split.filter(item["_corrupt_record"].isNull()), columns, keep=kept)


def searched_rss(items: DataFrame, params: Params, keep: Column | None = None) -> DataFrame:
    return items.filter(_or_kept(matches_any(F.col("item.title"), params.search_words), keep))


def with_page_text(postings: DataFrame, pages: DataFrame, params: Params = Params()) -> DataFrame:
    """Replace short descriptions by the longer text of the posting's own page.

    ``pages``: (url, main_text); of a url that was landed more than once the longest text
    counts. Without ``min_description_chars`` every description counts as short. Long
    ones can never change, so they bypass the join and their text is not shuffled.
    """
    length = F.length(text_or_empty(F.col("description")))
    short = text_or_empty(F.col("url")) != ""
    if params.min_description_chars is not None:
        short = short & (length < params.min_description_chars)
    texts = pages.filter("url IS NOT NULL").groupBy("url").agg(
        F.max_by("main_text", F.struct(F.length("main_text"), F.col("main_text"))).alias("_page_text"))
    longer = F.length("_page_text") > length
    filled = postings.filter(short).join(texts, "url", "left").withColumn(
        "description", F.when(longer, F.col("_page_text")).otherwise(F.col("description"))
    )
    return postings.filter(~short).unionByName(filled.drop("_page_text"))
