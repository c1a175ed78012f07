"""Words of whole texts: one definition as Spark columns, one as numpy arrays inside tasks.

A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage
return. Lower-casing touches A-Z only. ``bytes.split`` and ``bytes.lower`` do exactly that.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that are hashed in one go; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20260113))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: Column) -> Column:
    """Array of the words; empty for null and for blank texts."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def blocks(texts: Iterable[str | None], lower: bool = True) -> Iterator[tuple[int, int, bytes]]:
    """(first, last, bytes) of runs of texts: words parted by one space, texts by a line feed."""
    held: list[bytes] = []
    size = first = at = 0
    for at, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        held.append(b" ".join((data.lower() if lower else data).split()))
        size += len(data)
        if size >= BLOCK_BYTES:
            yield first, at + 1, b"\n".join(held)
            held, size, first = [], 0, at + 1
    if held:
        yield first, at + 1, b"\n".join(held)


def word_hashes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of a block, and the place of its text within the block."""
    data = np.frombuffer(block, np.uint8)
    gap = (data == 32) | (data == 10)
    inside = ~gap
    starts = np.flatnonzero(inside & np.concatenate(([True], gap[:-1]))) if len(data) else np.empty(0, np.int64)
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    ends = np.flatnonzero(inside & np.concatenate((gap[1:], [True]))) + 1
    lengths = ends - starts
    letters = data[inside]
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(firsts, lengths)
    value = _BYTE[letters] * _PLACE[place & 4095]
    # a word's hash rests on its own bytes only: letters of a short word stay as they are beside a long one
    far = np.flatnonzero(place >= 4096)
    if len(far):
        value[far] = mix(value[far] + (place[far] >> 12).astype(np.uint64))
    hashes = mix(np.add.reduceat(value, firsts) + lengths.astype(np.uint64))
    return hashes, np.searchsorted(np.flatnonzero(data == 10), starts)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of one word sequence; of the whole, if it is shorter."""
    if len(hashes) == 0:
        return hashes
    width = min(n, len(hashes))
    count = len(hashes) - width + 1
    total = np.zeros(count, np.uint64)
    for k in range(width):
        total += hashes[k : k + count] * _STEP[k]
    return mix(total + np.uint64(width))
