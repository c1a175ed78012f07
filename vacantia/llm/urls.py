"""URL filters by a sorted digest array.

The rules are one file: sorted 64-bit xxhash keys, then string offsets, verdicts and the rule
strings. Spark ships it to every executor (``addFile``), where tasks memory-map it, look up all
candidate keys of a batch with one binary search and compare the stored strings, so a key that
collides decides nothing. The list is a parameter of at most ``MAX_RULES`` entries.

A rule ``host/path`` fits its host and all subdomains if the url's path starts with its path; the
longest fitting rule wins (of equally long ones the one with the longer host). Without a fitting
rule the host's words (parts between dots and hyphens) are looked up as ``#word`` entries: a
blocked word blocks, anything else is allowed.

Defined cases: a null url or one without ``://`` has an empty host and path and is allowed; an
empty path fits no rule, as each rule's path starts with a slash; repeated rows are judged alike; other columns are not read.
"""
from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RULES = 5_000_000
#: The rules of the query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Words of host names that block a page which no rule decides.
BLOCKED_WORDS = ("adult", "ads", "bet", "bets", "casino", "escort", "pills", "poker", "porn", "spam", "viagra", "xxx")
VERDICTS = ("allow", "block")
SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format("url"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def entries(rules: Mapping[str, str], words: tuple[str, ...]) -> dict[str, str]:
    return dict(rules) | {f"#{w}": "block" for w in words}


def digest_bytes(listed: Mapping[str, str]) -> bytes:
    """count | sorted keys | string ends | verdicts | strings, little-endian."""
    if len(listed) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rows = sorted((xxhash.xxh64_intdigest(s.encode()), s.encode(), VERDICTS.index(v)) for s, v in listed.items())
    ends = np.cumsum([len(s) for _, s, _ in rows], dtype="<u8") if rows else np.empty(0, "<u8")
    return b"".join((
        np.array([len(rows)], "<u8").tobytes(), np.array([k for k, _, _ in rows], "<u8").tobytes(), ends.tobytes(),
        bytes(v for _, _, v in rows), b"".join(s for _, s, _ in rows)))


class DigestArray:
    """A memory-mapped digest file."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, np.uint8, "r")
        n = int(data[:8].view("<u8")[0])
        self.keys = data[8 : 8 + 8 * n].view("<u8")
        ends = data[8 + 8 * n : 8 + 16 * n].view("<u8")
        self.stop, self.start = ends, np.concatenate((np.zeros(1, "<u8"), ends[:-1]))
        self.verdicts = data[8 + 16 * n : 8 + 17 * n]
        self.text = data[8 + 17 * n :]

    def find(self, strings: list[bytes]) -> np.ndarray:
        """The entry of each string, or -1."""
        found = np.full(len(strings), -1)
        if not len(self.keys) or not strings:
            return found
        probes = np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))
        first = np.searchsorted(self.keys, probes)
        last = np.searchsorted(self.keys, probes, side="right")
        for i in np.flatnonzero(last > first):
            for at in range(first[i], last[i]):
                if self.text[int(self.start[at]) : int(self.stop[at])].tobytes() == strings[i]:
                    found[i] = at
        return found


def shape(listed: Mapping[str, str]) -> tuple[int, tuple[int, ...]]:
    """Most labels of a rule's host, and the lengths of the rules' paths: what has to be probed."""
    rules = [s.encode().partition(b"/") for s in listed if s[:1] != "#"]
    return max((h.count(b".") + 1 for h, _, _ in rules), default=0), tuple(sorted({len(p) + 1 for _, _, p in rules}))


def candidates(host: bytes, path: bytes, labels: int, lengths: tuple[int, ...]) -> list[bytes]:
    """Every rule string that would fit, the longest first."""
    hosts = [host]
    at = host.find(b".")
    while at >= 0:
        hosts.append(host[at + 1 :])
        at = host.find(b".", at + 1)
    fits = [h + path[:n] for h in hosts[-labels:] if h for n in lengths if len(path) >= n and path[:1] == b"/"] if labels else []
    return sorted(fits, key=lambda s: (len(s), s.find(b"/")), reverse=True)


def judge(batches: Iterator[pa.RecordBatch], file: str, labels: int, lengths: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    table = DigestArray(SparkFiles.get(file))
    for batch in batches:
        hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
        probes: list[bytes] = []
        parts: list[tuple[int, int, int]] = []
        for host, path in zip(hosts, paths, strict=True):
            h = host.encode()
            a = len(probes)
            probes += candidates(h, path.encode(), labels, lengths)
            b = len(probes)
            probes += [b"#" + w for w in h.replace(b".", b"-").split(b"-")] if h else []
            parts.append((a, b, len(probes)))
        found = table.find(probes)
        rules: list[str | None] = []
        verdicts: list[str] = []
        for a, b, c in parts:
            fit = next((i for i in range(a, b) if found[i] >= 0), -1)
            rules.append(probes[fit].decode() if fit >= 0 else None)
            hit = [fit] if fit >= 0 else [i for i in range(b, c) if found[i] >= 0]
            verdicts.append(VERDICTS[max((int(table.verdicts[found[i]]) for i in hit), default=0)])
        yield pa.RecordBatch.from_pydict({
            "page_id": batch.column("page_id"), "host": batch.column("host"), "path": batch.column("path"),
            "rule": pa.array(rules, pa.string()), "verdict": pa.array(verdicts, pa.string())})


def ship(spark: SparkSession, data: bytes) -> str:
    """Hands the file to all executors; its name follows its content."""
    name = f"url-digests-{hashlib.sha256(data).hexdigest()[:16]}.bin"
    if not os.path.exists(SparkFiles.get(name)):
        folder = tempfile.mkdtemp()  # of the driver; Spark copies the file from here to the executors
        atexit.register(shutil.rmtree, folder, True)
        with open(os.path.join(folder, name), "wb") as f:
            f.write(data)
        spark.sparkContext.addFile(os.path.join(folder, name))
    return name


def filtered(pages: DataFrame, rules: Mapping[str, str], words: tuple[str, ...] = BLOCKED_WORDS) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    listed = entries(rules, words)
    file = ship(pages.sparkSession, digest_bytes(listed))
    labels, lengths = shape(listed)
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").select("page_id", host.alias("host"), path.alias("path"))
    return parsed.mapInArrow(lambda batches: judge(batches, file, labels, lengths), SCHEMA)


ORACLE = """
WITH parsed AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parsed),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM split)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN rule IS NOT NULL THEN 'block'
  WHEN list_has_any(string_split(replace(host, '.', '-'), '-'), [{words}]) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled""".format(words=", ".join(f"'{w}'" for w in BLOCKED_WORDS))
