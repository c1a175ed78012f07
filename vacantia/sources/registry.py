"""Which sources take part in a run, and their union."""
from __future__ import annotations

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from vacantia.operators import dedup
from vacantia.params import Params
from vacantia.schema import CANONICAL
from vacantia.sources import feeds
from vacantia.sources.workdir import work_dir

# --- Fixed values: arrival order of the sources ---
SOURCE_ORDER = ("himalayas", "remoteok", "weworkremotely", "jsearch", "adzuna", "arbeitnow")
# which record of a URL that several keyword searches found counts
FIRST_OF_URL = ("himalayas",)
LAST_OF_URL = ("jsearch", "adzuna")
# --- end of fixed values ---

#: A posting's place among those of its source: the rank of its file, and its place in the file.
ARRIVAL = ("file_ord", "pos")
REJECTS = "source string, file string, pos long, error string"


def ranked_files(rows: DataFrame) -> DataFrame:
    """(file, file_ord, round): files in the order they were asked for, and the search each answers.

    One row per landed file, a list that Spark's own scan holds on the driver as well.
    """
    files = rows.select("file", "country", "keyword_ord", "page").distinct()
    country = F.array_position(F.array(*[F.lit(x) for x in feeds.ADZUNA_COUNTRIES]), F.col("country"))
    search = [country, F.col("keyword_ord")]
    return files.select(
        "file", F.row_number().over(Window.orderBy(*search, "page", "file")).alias("file_ord"),
        F.dense_rank().over(Window.orderBy(*search)).alias("round"))


def read_pages(payloads: DataFrame) -> DataFrame:
    """(page, n_jobs, last_page) of the payloads of a paged feed."""
    envelope = F.from_json("value", "data array<variant>, meta struct<last_page: bigint>")
    read = payloads.select("page", envelope.alias("e"))
    return read.groupBy("page").agg(
        F.sum(F.greatest(F.size(F.coalesce("e.data", F.array())), F.lit(0))).alias("n_jobs"), F.max("e.meta.last_page").alias("last_page"))


def settled(rows: DataFrame, name: str, params: Params, page_texts: DataFrame | None = None, listing: DataFrame | None = None) -> DataFrame:
    """Postings of a source's parsed rows with their arrival columns, cut and de-duplicated as the source asks for.

    ``page_texts`` (url, main_text) fills in short RSS descriptions; ``listing`` (:func:`read_pages`) tells
    where a paged feed ends. The limits act only where the parameters set them.
    """
    # written, so that the join is planned by its size and the rows aren't shuffled for a short list
    found = rows.filter("error IS NULL").join(staged(ranked_files(rows)), "file")
    if name == "weworkremotely" and page_texts is not None:
        found = feeds.with_page_text(found, page_texts, params)
    if listing is not None and params.max_pages is not None:
        read = dedup.page_cutoff(listing.withColumn("run", F.lit(0)), "run", params.max_pages)
        found = found.join(read.select("page"), "page", "left_semi")
    cap = params.per_source_cap
    columns = [*ARRIVAL, "file", *CANONICAL]
    if name in FIRST_OF_URL + LAST_OF_URL:
        keep = "first" if name in FIRST_OF_URL else "last"
        if cap is not None:
            placed = found.withColumns({"all": F.lit(0), "at": dedup.packed_position(found, ARRIVAL)})
            found = dedup.cap_by_round(placed, cap, "all", "url", "round", "at", keep)
        elif keep == "first":
            found = dedup.distinct_first(found, ["url"], ARRIVAL)
        else:
            found = dedup.distinct_last(found, "url", ARRIVAL)
    elif cap is not None:
        found = dedup.cap_per_group(found.withColumn("all", F.lit(0)), cap, "all", ARRIVAL)
    return found.select(*columns)


def rejects_of(rows: DataFrame, name: str) -> DataFrame:
    return rows.filter("error IS NOT NULL").select(F.lit(name).alias("source"), "file", F.col("pos").cast("long"), "error")


def staged(df: DataFrame) -> DataFrame:
    """``df`` as a written table; texts of records take half the disk that the default compression leaves them."""
    path = work_dir(df.sparkSession, "landed")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _readable(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """(files that can be read to their end, the others as rejects): names only, as a scan lists them."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"))
    texts = spark.read.format("text").options(wholetext=True, recursiveFileLookup=True, ignoreCorruptFiles=True).load(path)
    whole = staged(texts.select(F.col("_metadata.file_path").alias("file"), F.length("value").alias("n")))
    bad = every.join(whole, "file", "left_anti")
    return [r.file for r in whole.collect()], bad.select("file", F.lit(None).cast("long").alias("pos"), F.lit("unreadable file").alias("error"))


def landed_source(
    spark: SparkSession, name: str, path: str, params: Params, pages: DataFrame | None = None, large: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(canonical postings with their arrival columns, rejects) of one source's folder.

    The folder is read once, into a written table; with ``large``, JSON files of any size record by record.
    If reading fails, the files that can't be read to
    their end become rejects and the others are read.
    """
    broken = None
    records = large and name in feeds.RECORD_KEY
    try:
        landed = feeds.read_records(spark, name, path) if records else feeds.read_landed(spark, name, path)
        rows = staged(feeds.parsed(landed, name, params))
    except AnalysisException:
        raise
    except (PySparkException, Py4JJavaError):
        files, broken = _readable(spark, path)
        if broken.isEmpty():
            raise
        if not files:
            return spark.createDataFrame([], _found_schema()), broken.select(F.lit(name).alias("source"), "*")
        path = files
        rows = staged(feeds.parsed(feeds.read_landed(spark, name, path), name, params))
    paged = params.max_pages is not None and name == "arbeitnow"
    listing = read_pages(feeds.read_payloads(spark, path)) if paged else None
    bad = rejects_of(rows, name)
    if broken is not None:
        bad = bad.unionByName(broken.select(F.lit(name).alias("source"), "*"))
    return settled(rows, name, params, pages, listing), bad


def _found_schema() -> str:
    return "file_ord int, pos long, file string, " + ", ".join(f"{n} {t.simpleString()}" for n, t in feeds.CANONICAL_FIELDS)


def ingest_sources(
    spark: SparkSession, landing: str, params: Params = Params(), pages: DataFrame | None = None, large: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """All enabled sources under ``<landing>/<source>``: (postings with ``source_ord``, rejects).

    Each source is read on its own. One whose folder is missing or can't be read is one reject with the
    reason; the others go on. Order the postings by ``source_ord`` and the arrival columns.
    """
    found: dict[str, DataFrame] = {}
    rejects = [spark.createDataFrame([], REJECTS)]
    for name in (n for n in SOURCE_ORDER if n in params.enabled_sources):
        try:
            found[name], bad = landed_source(spark, name, f"{landing}/{name}", params, pages, large)
            rejects.append(bad)
        except (PySparkException, Py4JJavaError) as error:
            reason = error.getCondition() if isinstance(error, PySparkException) else None
            rejects.append(spark.createDataFrame([(name, None, None, reason or "unreadable source")], REJECTS))
    if not found:
        raise ValueError("no enabled source has data")
    return union_sources(found, params), reduce(lambda a, b: a.unionByName(b), rejects)


def union_sources(feeds: dict[str, DataFrame], params: Params) -> DataFrame:
    """UNION ALL of the enabled sources; ``source_ord`` keeps their order."""
    enabled = [name for name in SOURCE_ORDER if name in params.enabled_sources and name in feeds]
    if not enabled:
        raise ValueError("no enabled source has data")
    parts = [feeds[name].withColumn("source_ord", F.lit(SOURCE_ORDER.index(name)).cast("tinyint")) for name in enabled]
    return reduce(lambda a, b: a.unionByName(b), parts)


def ingest_totals(postings: DataFrame) -> DataFrame:
    """Rows per source and overall (``(all)``): counted map-side before the shuffle."""
    return (
        postings.rollup("source").agg(F.count(F.lit(1)).alias("postings"))
        .select(F.coalesce("source", F.lit("(all)")).alias("source"), "postings")
    )
