"""Packed token-id matrices: best-fit-decreasing with a segment tree over free space.

Each text's ids (and an end id) are cut into pieces of at most ``length`` without loss: whole rows
first, then the rest. Whole rows stand alone; the rests, longest first, each go into the row with the
least free space that holds them, found by one descent of a segment tree over the possible free
spaces. A task packs its texts a bounded number of tokens at a time, so nothing is shuffled and no
task holds more; what is left open at the end of a chunk costs at most a row or so.

A packed row has ``ids`` (``length`` little-endian unsigned 32-bit integers, padded), ``ends`` (ends of
its segments, cumulative, from 0), ``resets`` (where positions start again) and the segments' document
ids, with each segment's first place within its document, so that texts can be put together again.

Defined cases: null and empty texts consist of their end id; repeated rows are packed each;
a null doc_id stays null in the list of ids; other columns are not read; an empty table gives an empty result.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


LENGTH = 2048
#: Tokens that are packed together.
CHUNK = 2_000_000
SCHEMA = "pack long, ids binary, ends array<int>, resets array<int>, doc_ids array<long>, starts array<long>"


@lru_cache(4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """One per worker process."""
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class FreeSpace:
    """Rows by their free space; a segment tree finds the least space that is enough."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, row: int, space: int) -> None:
        self.rows[space].append(row)
        at = space + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, space) of the tightest row with ``need`` places, taken out; None if there is none."""
        at = need + self.size
        if not self.count[at]:
            # up to the first right neighbour that has rows, then down its left side
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        space = at - self.size
        row = self.rows[space].pop()
        while at:
            self.count[at] -= 1
            at >>= 1
        return row, space


def packed(sizes: list[int], length: int) -> list[list[tuple[int, int, int]]]:
    """Rows of segments (text, first, last) that hold every text of the given size, in pieces of at most ``length``."""
    rows: list[list[tuple[int, int, int]]] = []
    rests = []
    for text, size in enumerate(sizes):
        whole = size - size % length
        rows += [[(text, a, a + length)] for a in range(0, whole, length)]
        if size > whole:
            rests.append((whole - size, text, whole, size))
    free = FreeSpace(length)
    for _, text, first, last in sorted(rests):
        need = last - first
        found = free.take(need)
        if found is None:
            found = (len(rows), length)
            rows.append([])
        rows[found[0]].append((text, first, last))
        if found[1] > need:
            free.put(found[0], found[1] - need)
    return rows


def matrices(docs: DataFrame, rank_file: str, pattern: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """One row per packed row: number within its task's range, ids, ends, resets, document ids and starts."""

    def rows_of(ids: list[bytes], names: list[int | None], pack: int) -> Iterator[pa.RecordBatch]:
        rows = packed([len(x) // 4 for x in ids], length)
        pad = np.array([end_id], "<u4").tobytes()
        for a in range(0, len(rows), 256):
            part = rows[a : a + 256]
            data = [b"".join([ids[t][4 * x : 4 * y] for t, x, y in row]).ljust(4 * length, b"\0") for row in part]
            ends = [np.cumsum([0] + [y - x for _, x, y in row]).tolist() for row in part]
            data = [d[: 4 * e[-1]] + pad * (length - e[-1]) for d, e in zip(data, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(pack + a, pack + a + len(part)), pa.int64()), pa.array(data, pa.binary()), pa.array(ends, pa.list_(pa.int32())),
                 pa.array([e[:-1] for e in ends], pa.list_(pa.int32())), pa.array([[names[t] for t, _, _ in row] for row in part], pa.list_(pa.int64())),
                 pa.array([[x for _, x, _ in row] for row in part], pa.list_(pa.int64()))],
                ["pack", "ids", "ends", "resets", "doc_ids", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(rank_file, pattern).encode_to_numpy
        end = np.array([end_id], "<u4").tobytes()
        ids: list[bytes] = []
        names: list[int | None] = []
        size = pack = 0
        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(encode(text.as_py() or "").astype("<u4").tobytes() + end)
                names.append(name)
                size += len(ids[-1]) // 4
                if size >= CHUNK:
                    for out in rows_of(ids, names, pack):
                        yield out
                        pack += out.num_rows
                    ids, names, size = [], [], 0
        yield from rows_of(ids, names, pack)

    packs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
    return packs.withColumn("part", F.spark_partition_id()).select("part", "pack", "ids", "ends", "resets", "doc_ids", "starts")


def written(docs: DataFrame, path: str, *args, **options) -> DataFrame:
    """The packed rows as a Parquet dataset under ``path``, read back."""
    matrices(docs, *args, **options).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def digests(packs: DataFrame) -> DataFrame:
    """Per packed row: its place, sizes, segments, and the digest of its ids."""
    return packs.select(
        "part", "pack", F.element_at("ends", -1).cast("long").alias("n_tokens"), F.size("resets").cast("long").alias("n_segments"),
        F.sha2("ids", 256).alias("ids_sha256"), "ends", "resets", "doc_ids", "starts")
