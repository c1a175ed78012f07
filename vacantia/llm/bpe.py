"""Byte-level BPE by a rank file, and back.

A pre-token's byte pairs wait in one bucket per merge rank. A hierarchical bitmap marks the
buckets that are not empty: 256-bit words under a word over these words; find-first-set from
the top gives the lowest rank in as many steps as there are levels. Buckets hold positions of a
linked list of pieces, leftmost first; an entry whose pair has changed meanwhile is skipped. The
work per merge doesn't grow with a pre-token's length, and all pre-tokens that a block of texts
newly brings share one queue, with a gap between neighbours that no pair reaches over.

Texts go through Arrow batches, a block of texts at a time. Each worker keeps the ids of the chunks
and pre-tokens it met, in two generations of bounded size; no result depends on what is kept. A worker
that has encoded nothing for ``IDLE`` seconds gives them back, so that other stages don't run beside them.

Defined cases: a null text counts as empty, and an empty text has no ids; special tokens in a text
are ordinary text; repeated rows are encoded alike; other columns are not read.
"""
from __future__ import annotations

import base64
import gc
import hashlib
import threading
from array import array
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a generation of kept chunks (and a quarter as many of pre-tokens), what an entry takes besides its
#: letters and ids, the longest of these, text taken together, and bytes of pre-tokens merged together.
CACHE = 64 << 20
ENTRY = 160
KEPT_CHARS = 64
BLOCK_CHARS = 1_000_000
MERGED = 256 << 10
#: Seconds for which a worker that encodes nothing keeps its encoders.
IDLE = 5
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class RankQueue:
    """Which ranks are waiting: a bitmap of 256-bit words under bitmaps of its words."""

    def __init__(self, ranks: int) -> None:
        self.levels: list[list[int]] = []
        while True:
            ranks = (ranks + 255) >> 8
            self.levels.append([0] * ranks)
            if ranks == 1:
                break
        self.down = self.levels[::-1]

    def add(self, rank: int) -> None:
        for level in self.levels:
            at = rank >> 8
            word = level[at]
            level[at] = word | 1 << (rank & 255)
            if word:
                return
            rank = at

    def first(self) -> int:
        """The lowest rank, or -1."""
        at = 0
        for level in self.down:
            word = level[at]
            if not word:
                return -1
            at = at << 8 | (word & -word).bit_length() - 1
        return at

    def remove(self, rank: int) -> None:
        for level in self.levels:
            at = rank >> 8
            level[at] &= ~(1 << (rank & 255))
            if level[at]:
                return
            rank = at


class Kept:
    """The entries met last, in two generations of so many bytes: when one is full, the one before it goes.
    What is met again in the older one moves to the younger."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.held = 0
        self.fresh: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        found = self.fresh.get(key)
        if found is None:
            found = self.aged.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key: str, ids: bytes) -> None:
        if len(key) <= KEPT_CHARS:
            if self.held >= self.size:
                self.aged, self.fresh, self.held = self.fresh, {}, 0
            self.fresh[key] = ids
            self.held += ENTRY + len(key) + len(ids)


class Bpe:
    def __init__(self, rank_file: str, pattern: str) -> None:
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.packed = {piece: rank.to_bytes(4, "little") for piece, rank in self.ranks.items()}
        self.pairs = np.full(1 << 16, -1)
        for piece, rank in self.ranks.items():
            if len(piece) == 2:
                self.pairs[piece[0] << 8 | piece[1]] = rank
        self.find: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.chunks, self.tokens = Kept(CACHE), Kept(CACHE // 4)

    def merge(self, tokens: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as little-endian unsigned 32-bit integers; so many bytes at a time share a queue."""
        out: list[bytes] = []
        held: list[bytes] = []
        size = 0
        for token in tokens:
            held.append(token)
            size += len(token)
            if size >= MERGED:
                out += self.merged(held)
                held, size = [], 0
        return out + self.merged(held)

    def merged(self, tokens: list[bytes]) -> list[bytes]:
        if not tokens:
            return []
        packed = self.packed
        get = self.ranks.get
        data = b"\0".join(tokens) + b"\0"  # a gap after each
        n = len(data)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        gaps = np.cumsum(sizes + 1) - 1
        inner = np.ones(n, bool)
        inner[gaps] = False
        stop_at = np.arange(1, n + 1)  # of the piece that starts here; 0 inside a piece and in a gap
        stop_at[gaps] = 0
        before_at = np.arange(-1, n - 1)  # start of the piece before; -1 at a pre-token's start
        before_at[gaps - sizes] = -1
        byte = np.frombuffer(data, np.uint8).astype(np.int64)
        waits_at = np.full(n, -1)  # the rank of the pair that starts here, as of now
        both = np.flatnonzero(inner[:-1] & inner[1:])
        waits_at[both] = self.pairs[byte[both] << 8 | byte[both + 1]]
        # four bytes a place; lists are faster, and short enough where no pre-token is long
        stop, before, waits = (x.tolist() if n <= 2 * MERGED else array("i", x.astype(np.int32).tobytes()) for x in (stop_at, before_at, waits_at))
        buckets: list[list[int] | None] = [None] * len(self.pieces)
        queue = RankQueue(len(self.pieces))
        first, add, remove = queue.first, queue.add, queue.remove
        paired = np.flatnonzero(waits_at >= 0)
        paired = paired[np.argsort(waits_at[paired], kind="stable")]
        heads = np.flatnonzero(np.diff(waits_at[paired], prepend=-1))
        for rank, low, high in zip(waits_at[paired[heads]].tolist(), heads.tolist(), np.append(heads[1:], len(paired)).tolist(), strict=False):
            buckets[rank] = paired[low:high].tolist()
            add(rank)
        while (rank := first()) >= 0:
            bucket = buckets[rank]
            buckets[rank] = None
            remove(rank)
            bucket.sort()
            for done, i in enumerate(bucket, 1):
                if waits[i] != rank:
                    continue  # a stale entry
                middle = stop[i]
                end = stop[middle]
                stop[i] = end
                stop[middle] = 0
                waits[middle] = -1
                lowest = rank + 1
                after = stop[end]
                if after:
                    before[end] = i
                    new = get(data[i:after], -1)
                    waits[i] = new
                    if new >= 0:
                        if new < lowest:
                            lowest = new
                        other = buckets[new]
                        if other is None:
                            buckets[new] = [i]
                            add(new)
                        else:
                            other.append(i)
                else:
                    waits[i] = -1
                left = before[i]
                if left >= 0:
                    new = get(data[left:end], -1)
                    waits[left] = new
                    if new >= 0:
                        if new < lowest:
                            lowest = new
                        other = buckets[new]
                        if other is None:
                            buckets[new] = [left]
                            add(new)
                        else:
                            other.append(left)
                if lowest <= rank and done < len(bucket):
                    # the new pair goes first: what is left of this bucket waits again
                    if buckets[rank] is None:
                        buckets[rank] = bucket[done:]
                        add(rank)
                    else:
                        buckets[rank] += bucket[done:]
                    break
        out = []
        at = 0
        for token in tokens:
            i, last = at, at + len(token)
            ids = []
            while i < last:
                end = stop[i]
                ids.append(packed[data[i:end]])
                i = end
            out.append(b"".join(ids))
            at = last + 1
        return out

    def pre_tokens(self, chunks: list[str]) -> list[list[str]]:
        """Pre-tokens of chunks that begin with their only space, found in one text: each space begins a chunk."""
        if not chunks:  # all are known, or the texts have none
            return []
        tokens = self.find("".join(chunks))
        starts = [i for i, t in enumerate(tokens) if t[:1] == " "]
        if len(starts) != len(chunks):  # a pattern that leaves spaces out
            return [self.find(c) for c in chunks]
        parts = [tokens[a:b] for a, b in zip(starts, [*starts[1:], len(tokens)], strict=True)]
        return [part if "".join(part) == c else self.find(c) for part, c in zip(parts, chunks, strict=True)]

    def token_ids(self, tokens: Iterable[str], missed: dict[str, list[str]]) -> dict[str, bytes]:
        """Ids of different pre-tokens; those not met lately are merged together. ``missed``: chunks that aren't kept."""
        found: dict[str, bytes] = {}
        new: list[str] = []
        for token in tokens:
            ids = self.tokens.get(token) or (None if token in missed else self.chunks.get(token))
            if ids is None:
                new.append(token)
            else:
                found[token] = ids
        data = [t.encode("utf-8", "surrogatepass") for t in new]
        whole = [self.packed.get(d) for d in data]  # a piece of the vocabulary is its own id
        merged = iter(self.merge([d for d, w in zip(data, whole, strict=True) if w is None]))
        found.update((t, next(merged) if w is None else w) for t, w in zip(new, whole, strict=True))
        return found

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """Ids of each text.

        Where single spaces part runs of other characters, no pre-token reaches over a space but by
        starting with it, so " word" is a chunk on its own. A text with other spaces beside a space
        or at an end is a chunk as a whole.
        """
        split: list[list[str] | None] = []
        new: dict[str, list[str]] = {}
        whole: dict[str, list[str]] = {}
        known: dict[str, bytes] = {}
        kept = self.chunks
        get = kept.get
        for text in texts:
            chunks = text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]
            for chunk in set(chunks).difference(known):
                if chunk not in new:
                    ids = get(chunk)
                    if ids is not None:
                        known[chunk] = ids
                        continue
                    word = chunk[1:] if chunk[:1] == " " else chunk
                    if not word or word[0].isspace() or word[-1].isspace():
                        # such a chunk is never kept, so it is met again here
                        chunks = None
                        whole[text] = self.find(text)
                        break
                    new[chunk] = [] if chunk[:1] == " " and "\0" not in chunk else self.find(chunk)
            split.append(chunks)
        spaced = [chunk for chunk in new if chunk[:1] == " " and "\0" not in chunk]
        new.update(zip(spaced, self.pre_tokens(spaced), strict=True))
        ids_of = self.token_ids(dict.fromkeys(t for tokens in (*new.values(), *whole.values()) for t in tokens), new)
        for chunk, tokens in new.items():
            ids = known[chunk] = ids_of[tokens[0]] if len(tokens) == 1 else b"".join([ids_of[t] for t in tokens])
            if "\0" not in chunk:
                kept.put(chunk, ids)
                if len(tokens) > 1:
                    for token in tokens:
                        if self.tokens.get(token) is None:
                            self.tokens.put(token, ids_of[token])
        joined = {text: b"".join([ids_of[t] for t in tokens]) for text, tokens in whole.items()}
        return [joined[text] if chunks is None else b"".join(map(known.__getitem__, chunks)) for text, chunks in zip(texts, split, strict=True)]

    def encode_uncollected(self, texts: list[str]) -> list[bytes]:
        """:meth:`encode_block` without the cycle collector, which walks the cache again and again: no cycles arise here."""
        on = gc.isenabled()
        gc.disable()
        try:
            return self.encode_block(texts)
        finally:
            if on:
                gc.enable()

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= BLOCK_CHARS:
                yield from self.encode_uncollected(held)
                held, size = [], 0
        yield from self.encode_uncollected(held)

    def encode(self, text: str) -> bytes:
        return self.encode_block([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_loaded: dict[tuple[str, str], Bpe] = {}
_leaving: list[threading.Timer] = []


def loaded(rank_file: str, pattern: str) -> Bpe:
    """One per worker process: a reused worker keeps its cache."""
    found = _loaded.get((rank_file, pattern))
    if found is None:
        found = _loaded[rank_file, pattern] = Bpe(rank_file, pattern)
    return found


@contextmanager
def working(rank_file: str, pattern: str) -> Iterator[Bpe]:
    """The worker's encoder for one task; unless another task asks for it soon, it goes."""
    while _leaving:
        _leaving.pop().cancel()
    try:
        yield loaded(rank_file, pattern)
    finally:
        timer = threading.Timer(IDLE, _loaded.clear)
        timer.daemon = True
        timer.start()
        _leaving.append(timer)


def encoded(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and the ids (binary, little-endian unsigned 32-bit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working(rank_file, pattern) as bpe:
            for batch in batches:
                ids = pa.array(bpe.encode_all(_texts(batch)), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes they decode to, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with working(rank_file, pattern) as bpe:
            for batch in batches:
                sizes, ids_sha, text_sha = [], [], []
                for ids in bpe.encode_all(_texts(batch)):
                    sizes.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    for text in batch.column(1):
        yield text.as_py()
