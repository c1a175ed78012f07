"""The state: bucketed Parquet folders under one manifest per generation.

A table is dealt into buckets by the first hex digits of its key's hash. A manifest names one folder per
(table, bucket); the newest one is the state. A run writes new folders for the buckets it changes and one
manifest at the end, so tables and buckets it doesn't touch keep their files, nothing is ever overwritten,
and a run that dies leaves the old state in force. Creating the manifest is the commit: it fails if another
writer has taken that generation. (The store has to create files exclusively, as HDFS and local disks do.)

The status of a posting is a narrow table of its own: changing it never rewrites a text. Files are sorted by
key within a bucket and carry Bloom filters on it, so that a few keys can be looked up by a few row groups.
"""
from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from vacantia.schema import POSTINGS, STATE_TABLES

COMMITS, TABLES, STAGING = "_commits", "tables", "_staging"
CONTENT = T.StructType([f for f in POSTINGS if f.name != "status"])
STATUS = T.StructType([POSTINGS["url_hash"], POSTINGS["status"]])
#: What is stored: postings without their status, and the status.
STORED = STATE_TABLES | {"postings": CONTENT, "status": STATUS}
#: Hex digits of the hash that make a bucket: 16, 256, 4096 buckets. Fixed with the first generation.
DIGITS = 1
#: So many keys at most are looked up by filters; more of them by a join.
FILTERED_KEYS = 200


class StateConflict(RuntimeError):
    """Another writer committed the generation this one was to become."""


def key_of(name: str) -> str:
    return "cache_key" if name == "salary_lookup_cache" else "url_hash"


def bucket_of(name: str, digits: int) -> Column:
    """url_hash is a hash already; other keys are hashed."""
    key = F.col(key_of(name))
    return F.substring(key if name != "salary_lookup_cache" else F.sha2(key, 256), 1, digits)


# --- files of the store, through the file systems Spark itself uses

def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def _read_text(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _create(spark: SparkSession, path: str, text: str) -> None:
    """A new file; fails if it exists."""
    fs, where = _fs(spark, path)
    stream = fs.create(where, False)
    stream.write(text.encode())
    stream.close()


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


# --- reading

class Snapshot:
    """A committed generation, or (number 0) the empty state before the first one."""

    def __init__(self, spark: SparkSession, root: str, manifest: dict) -> None:
        self.spark, self.root = spark, root
        self.number: int = manifest["generation"]
        self.digits: int = manifest["digits"]
        self.folders: dict[str, dict[str, str]] = {name: dict(manifest["folders"].get(name, {})) for name in STORED}
        self.streams: dict[str, int] = dict(manifest["streams"])

    def read(self, name: str, buckets: Iterable[str] | None = None) -> DataFrame:
        """A stored table, or only some buckets of it."""
        held = self.folders[name]
        paths = [f"{self.root}/{held[b]}" for b in (sorted(held) if buckets is None else buckets) if b in held]
        if not paths:
            return self.spark.createDataFrame([], STORED[name])
        return self.spark.read.schema(STORED[name]).parquet(*paths)

    def buckets(self, name: str, rows: DataFrame) -> list[str]:
        """The buckets that hold the keys of ``rows``: 16 ** digits short texts at most."""
        found = rows.select(bucket_of(name, self.digits).alias("b")).filter("b IS NOT NULL").distinct()
        return sorted(r.b for r in found.collect())

    def postings(self, buckets: Iterable[str] | None = None) -> DataFrame:
        """Postings with their status, as users see them."""
        buckets = None if buckets is None else list(buckets)
        return with_status(self.read("postings", buckets), self.read("status", buckets))


def with_status(content: DataFrame, status: DataFrame) -> DataFrame:
    return content.join(status, "url_hash").select(*[f.name for f in POSTINGS])


def _manifests(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(name[:-5]) for name in _names(spark, f"{root}/{COMMITS}") if name.endswith(".json"))


def _manifest_path(root: str, number: int) -> str:
    return f"{root}/{COMMITS}/{number:09d}.json"


def snapshot(spark: SparkSession, root: str, digits: int = DIGITS) -> Snapshot:
    """The newest generation. One whose manifest was cut off while it was written isn't committed."""
    for number in reversed(_manifests(spark, root)):
        try:
            return Snapshot(spark, root, json.loads(_read_text(spark, _manifest_path(root, number))))
        except ValueError:
            continue
    return Snapshot(spark, root, {"generation": 0, "digits": digits, "folders": {}, "streams": {}})


def current_generation(spark: SparkSession, root: str) -> int | None:
    return snapshot(spark, root).number or None


def read_state(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The current tables; empty ones before the first run."""
    now = snapshot(spark, root)
    return {name: now.postings() if name == "postings" else now.read(name) for name in STATE_TABLES}


# --- writing

class Generation(Snapshot):
    """The next generation while it is written; reads give what it will hold. Nothing counts before ``commit``."""

    def __init__(self, spark: SparkSession, root: str, digits: int = DIGITS) -> None:
        base = snapshot(spark, root, digits)
        super().__init__(spark, root, {"generation": base.number + 1, "digits": base.digits, "folders": base.folders, "streams": base.streams})
        self._name = f"{self.number:09d}-{uuid.uuid4().hex[:12]}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """An intermediate table, written and read back: lineage ends there. It goes with the commit."""
        path = f"{self.root}/{STAGING}/{self._name}/{name}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def write(self, name: str, rows: DataFrame, buckets: Sequence[str] | None = None) -> None:
        """``rows`` become the content of the given buckets (of the table, without any)."""
        if buckets is not None and not buckets:
            return
        key = key_of(name)
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in STORED[name]]
        folder = f"{TABLES}/{name}/{self._name}-{uuid.uuid4().hex[:6]}"
        dealt = rows.select(*columns).withColumn("bucket", bucket_of(name, self.digits))
        (dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket")
            .option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
            .parquet(f"{self.root}/{folder}"))
        written = {n.removeprefix("bucket="): f"{folder}/{n}" for n in _names(self.spark, f"{self.root}/{folder}") if n.startswith("bucket=")}
        kept = {} if buckets is None else {b: f for b, f in self.folders[name].items() if b not in set(buckets)}
        self.folders[name] = kept | written

    def merge(self, name: str, changes: DataFrame) -> list[str]:
        """Insert or replace whole rows by key (``changes``: a written table, each key once); only the buckets
        that hold one of the keys are read, joined and written. Returns these buckets."""
        touched = self.buckets(name, changes)
        if touched:
            key = key_of(name)
            untouched = self.read(name, touched).join(changes.select(key), key, "left_anti")
            self.write(name, untouched.unionByName(changes.select(*[f.name for f in STORED[name]])), touched)
        return touched

    def commit(self, now: str) -> int:
        """Make this generation the current one, or fail if another writer has done so meanwhile."""
        text = json.dumps({
            "generation": self.number, "committed_at": now, "digits": self.digits, "folders": self.folders, "streams": self.streams}, sort_keys=True)
        try:
            _create(self.spark, _manifest_path(self.root, self.number), text)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName() or "already exists" in str(error.java_exception.getMessage()):
                raise StateConflict(f"generation {self.number} of {self.root} was committed by another writer") from error
            raise
        _delete(self.spark, f"{self.root}/{STAGING}/{self._name}")
        return self.number


def write_state(tables: dict[str, DataFrame], root: str, now: str) -> int:
    """The given tables as whole new ones in the next generation; the others keep their files."""
    new = Generation(next(iter(tables.values())).sparkSession, root)
    for name, rows in tables.items():
        if name == "postings":
            new.write("status", rows.select("url_hash", "status"))
        new.write(name, rows)
    return new.commit(now)


def expire(spark: SparkSession, root: str, keep: int = 3) -> list[str]:
    """Remove all but the newest ``keep`` generations: manifests, folders that no kept one names, and what
    writers that failed have left. Folders of a generation still being written stay. Returns the folders removed."""
    numbers = _manifests(spark, root)
    if not numbers:
        return []
    kept = [Snapshot(spark, root, json.loads(_read_text(spark, _manifest_path(root, n)))) for n in numbers[-keep:]]
    named = {folder.rsplit("/", 1)[0] for s in kept for held in s.folders.values() for folder in held.values()}
    for number in numbers[:-keep]:
        _delete(spark, _manifest_path(root, number))
    old = [f"{TABLES}/{name}/{x}" for name in STORED for x in _names(spark, f"{root}/{TABLES}/{name}")]
    old += [f"{STAGING}/{x}" for x in _names(spark, f"{root}/{STAGING}")]
    removed = [f for f in old if f not in named and int(f.rsplit("/", 1)[1][:9]) <= numbers[-1]]
    for folder in removed:
        _delete(spark, f"{root}/{folder}")
    return removed


def lookup(state: Snapshot, keys: DataFrame) -> DataFrame:
    """Full rows of the given ``url_hash`` keys.

    Only buckets that hold one of the keys are read. A few keys go to the scan as filters, where the order
    and the Bloom filters of the files leave a few row groups; many are met by a join.
    """
    wanted = keys.select("url_hash").distinct()
    few = sorted(r[0] for r in wanted.limit(FILTERED_KEYS + 1).collect() if r[0] is not None)
    if len(few) > FILTERED_KEYS:
        buckets = state.buckets("postings", wanted)
        return state.postings(buckets).join(wanted, "url_hash", "left_semi")
    rows = state.spark.createDataFrame([], POSTINGS)
    for bucket in sorted({k[: state.digits] for k in few}):
        here = F.col("url_hash").isin([k for k in few if k.startswith(bucket)])
        rows = rows.unionByName(with_status(state.read("postings", [bucket]).filter(here), state.read("status", [bucket]).filter(here)))
    return rows
