"""Cross-tokenizer alignment: the tokens of two tokenizers over one text, linked where their bytes overlap.

Token ends of both sides lie on one byte axis. A lane is a pair of pointers (A token, B token) that walks
along it; one NumPy state vector holds the lanes of all texts of a block and advances them together. Each
step links the two tokens every lane points at, notes a cut where both end, moves on whichever ends first
(both at a cut) and drops the lanes that are done. A long text is walked by several lanes, since a lane may
start at any A token, so that no text walks alone.

How often two ids are linked is counted over the whole corpus. A block keeps its distinct pairs as one list
and each link as a place in that list; the lists are added up by pair, and every block gets back the totals
of its own list, so that nothing of the size of the vocabulary product or of the corpus meets in one place.

Defined cases: a null, blank or empty text that doesn't survive both encodings byte by byte has no tokens
(zeros, no digest); repeated rows and null ids are rows like others and count like others; an empty table
gives an empty result; a text longer than a block is a block of its own; other columns are not looked at.
"""
from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.stored import stored

BLOCK_CHARS = 1_000_000
#: A tokens of a lane; longer texts get several.
LANE = 512
_SPLIT = 32  # bits of the B id within a pair

ALIGNED = "block long, pos int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, n binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
GROUPS = "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"


# --- the two tokenizers

def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(odd)}


class ByteSide:
    """Byte-level BPE of a tokenizers file. Where ids follow the merges, as ranks do, tiktoken merges them."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, model = _byte_letters(), file["model"]
        special = {t["content"] for t in file["added_tokens"] if t["special"]}
        vocab = {k: i for k, i in model["vocab"].items() if k not in special}
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.pieces[i] = bytes(letters[c] for c in piece)
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        ranked = all(vocab[m] == 256 + n for n, m in enumerate(merges)) and len(vocab) == 256 + len(merges)
        step = file["pre_tokenizer"] or {}
        usual = step.get("type") == "ByteLevel" and step.get("use_regex") and not step.get("add_prefix_space")
        if ranked and usual and not file["normalizer"] and not model["ignore_merges"]:
            import tiktoken

            own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks={p: i for i, p in enumerate(self.pieces)}, special_tokens={})
            self.encode = own.encode_ordinary
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            self.encode = lambda text: own.encode(text, add_special_tokens=False).ids


class PieceSide:
    """A SentencePiece model; it puts the space before the text itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [
            bytes([int(own.id_to_piece(i)[3:5], 16)]) if own.is_byte(i) else own.id_to_piece(i).replace("▁", " ").encode()
            for i in range(own.get_piece_size())]
        self.encode = own.encode


@dataclass(frozen=True)
class Pair:
    """Both tokenizers, by file; loaded once per worker."""

    a_path: str
    b_path: str
    pattern: str


@functools.lru_cache(2)
def _loaded(pair: Pair) -> tuple[ByteSide, PieceSide]:
    return ByteSide(pair.a_path, pair.pattern), PieceSide(pair.b_path)


# --- one block

@dataclass
class Block:
    """Texts of one block: ids of both sides in a row, byte ends on one axis, cuts and links."""

    n_a: np.ndarray  # per text
    n_b: np.ndarray
    a: np.ndarray
    b: np.ndarray
    a_cut: np.ndarray  # A token that closes each group, ascending
    b_cut: np.ndarray
    link_a: np.ndarray  # in the order of the axis
    link_b: np.ndarray
    n_groups: np.ndarray  # per text


def encoded(text: str | None, a: ByteSide, b: PieceSide) -> tuple[list[int], list[int]]:
    """Ids of both sides; none if a side doesn't give the text back."""
    if not text:
        return [], []
    whole = (" " + text).encode("utf-8", "surrogatepass")
    ids_a, ids_b = a.encode(" " + text), b.encode(text)
    same = all(b"".join([side.pieces[i] for i in ids]) == whole for side, ids in ((a, ids_a), (b, ids_b)))
    return (ids_a, ids_b) if same else ([], [])


def lanes(n_a: np.ndarray, a_end: np.ndarray, b_end: np.ndarray, lane: int = LANE) -> np.ndarray:
    """State vector (A token, B token, first A token behind the lane) at the start."""
    ends = np.cumsum(n_a)
    each = -(-n_a // lane)
    number = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    start = np.repeat(ends - n_a, each) + number * lane
    at = np.concatenate(([0], a_end))[start]
    return np.stack([start, np.searchsorted(b_end, at, side="right"), np.minimum(start + lane, np.repeat(ends, each))])


def lockstep(state: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links and cuts of all lanes, as A and B token places, in the order of steps."""
    links, cuts = [np.empty((2, 0), np.int64)], [np.empty((2, 0), np.int64)]
    while state.shape[1]:
        here = state[:2]
        links.append(here)
        end_a, end_b = a_end[here[0]], b_end[here[1]]
        cuts.append(here[:, end_a == end_b])
        moved = state.copy()
        moved[0] += end_a <= end_b
        moved[1] += end_b <= end_a
        state = moved[:, moved[0] < moved[2]]
    link_a, link_b = np.concatenate(links, axis=1)
    a_cut, b_cut = np.sort(np.concatenate(cuts, axis=1), axis=1)  # both sides ascend together
    return link_a, link_b, a_cut, b_cut


def block_of(texts: list[str | None], a: ByteSide, b: PieceSide, sizes: tuple[np.ndarray, np.ndarray], lane: int = LANE) -> Block:
    ids = [encoded(t, a, b) for t in texts]
    n_a, n_b = (np.fromiter((len(x[side]) for x in ids), np.int64, len(ids)) for side in (0, 1))
    all_a, all_b = (np.concatenate([np.empty(0, np.int64), *(np.asarray(x[side], np.int64) for x in ids)]) for side in (0, 1))
    a_end, b_end = np.cumsum(sizes[0][all_a]), np.cumsum(sizes[1][all_b])
    link_a, link_b, a_cut, b_cut = lockstep(lanes(n_a, a_end, b_end, lane), a_end, b_end)
    # every link moved A, B or (at a cut) both, so this is its place along the axis
    place = link_a + link_b - np.searchsorted(a_cut, link_a, side="left")
    ordered = np.empty((2, len(place)), np.int64)
    ordered[:, place] = link_a, link_b
    until = np.searchsorted(a_cut, np.cumsum(n_a), side="left")
    return Block(n_a, n_b, all_a, all_b, a_cut, b_cut, ordered[0], ordered[1], np.diff(until, prepend=0))


def spelled(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """All groups as text bytes (``a1,a2|b1;a3|b2,b3;``) and where each text's part ends."""
    group_a = np.searchsorted(block.a_cut, np.arange(len(block.a)), side="left")
    group_b = np.searchsorted(block.b_cut, np.arange(len(block.b)), side="left")
    first_b = np.concatenate(([0], block.b_cut + 1))
    place_a = np.arange(len(block.a)) + first_b[group_a]
    place_b = np.arange(len(block.b)) + block.a_cut[group_b] + 1 if len(block.b) else group_b
    ids = np.empty(len(block.a) + len(block.b), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    ids[place_a], ids[place_b] = block.a, block.b
    mark[place_a[block.a_cut]], mark[place_b[block.b_cut]] = ord("|"), ord(";")
    digits = np.ones(len(ids), np.int64)
    for k in range(1, len(str(ids.max(initial=0)))):
        digits += ids >= 10**k
    ends = np.cumsum(digits + 1)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    out[ends - 1] = mark
    rest, at, live = ids, ends - 2, digits
    while len(rest):
        out[at] = 48 + rest % 10
        more = live > 1
        rest, at, live = rest[more] // 10, at[more] - 1, live[more] - 1
    upto = np.cumsum(block.n_a + block.n_b)
    return out, np.concatenate(([0], ends))[upto]


def blocks_of(batches: Iterable[pa.RecordBatch], chars: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of runs of rows of about so many characters."""
    ids: list = []
    texts: list = []
    size = 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(doc_id)
            texts.append(text)
            size += len(text or "") + 1
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def packed(places: np.ndarray) -> bytes:
    """Places in a block's list; frequent pairs come first there, so that the upper bytes are mostly zero."""
    return zstandard.compress(places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _aligner(pair: Pair, chars: int, lane: int):
    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _loaded(pair)
        sizes = tuple(np.array([len(p) for p in side.pieces]) for side in (a, b))
        task = TaskContext.get().partitionId()
        for number, (ids, texts) in enumerate(blocks_of(batches, chars)):
            block = block_of(texts, a, b, sizes, lane)
            key = block.a[block.link_a] << _SPLIT | block.b[block.link_b]
            listed, at, counts = np.unique(key, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            links = place[at]
            n_links = block.n_a + block.n_b - block.n_groups
            spelling, ends = spelled(block)
            view, rows = memoryview(spelling), len(ids)
            link_ends = np.cumsum(n_links)
            columns = [
                np.arange(rows, dtype=np.int32), pa.array(ids, pa.int64()), block.n_a, block.n_b, block.n_groups, n_links,
                [hashlib.sha256(view[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(np.concatenate(([0], ends[:-1])), ends)],
                [packed(links[e - n : e]) if n else None for e, n in zip(link_ends, n_links)],
            ]
            name = (task << 24) + number
            yield pa.record_batch(
                [pa.array([name] * rows, pa.int64()), *[pa.array(c) for c in columns[:-1]], pa.array(columns[-1], pa.binary()),
                 pa.nulls(rows, pa.binary())], names=_NAMES)
            # the block's list is a row of its own, pairs and how often each occurs
            yield pa.record_batch(
                [pa.array([name]), *[pa.nulls(1, t) for t in _TYPES[1:8]], pa.array([listed[order].tobytes()], pa.binary()),
                 pa.array([counts[order].tobytes()], pa.binary())], names=_NAMES)

    return align


_NAMES = [x.split()[0] for x in ALIGNED.split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in ALIGNED.split(", ")]


# --- the corpus

def aligned(docs: DataFrame, pair: Pair, chars: int = BLOCK_CHARS, lane: int = LANE) -> DataFrame:
    """Rows of texts and of block lists (``pos`` null), written once."""
    return stored(docs.select("doc_id", "text").mapInArrow(_aligner(pair, chars, lane), ALIGNED))


def _listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, pairs, counts in zip(*(c.to_pylist() for c in batch.columns)):
            keys, n = np.frombuffer(pairs, np.int64), np.frombuffer(counts, np.int64)
            for first in range(0, len(keys), 100_000):
                part = slice(first, first + 100_000)
                size = len(keys[part])
                yield pa.record_batch(
                    [pa.array(np.full(size, name)), pa.array(np.arange(first, first + size)), pa.array(keys[part]), pa.array(n[part])],
                    names=["block", "at", "pair", "n"])


def block_pairs(rows: DataFrame) -> DataFrame:
    """(block, at, pair, n) of every block's list."""
    return rows.filter("pos IS NULL").select("block", "links", "n").mapInArrow(_listed, "block long, at long, pair long, n long")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a_id, b_id, n): how many links of the corpus hold each pair of ids."""
    totals = block_pairs(rows).groupBy("pair").agg(F.sum("n").alias("n"))
    return totals.select(F.shiftright("pair", _SPLIT).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << _SPLIT) - 1).cast("int").alias("b_id"), "n")


def _settler(best: np.ndarray):
    def settle(texts: pa.Table, totals: pa.Table) -> pa.Table:
        texts = texts.sort_by("pos")
        at, n = totals.column("at").to_numpy(), totals.column("total").to_numpy()
        counts = np.zeros(len(at), np.int64)
        counts[at] = n
        tops = np.zeros(len(at), bool)
        tops[at] = n == best[totals.column("b_id").to_numpy()]
        links = [unpacked(x) if x is not None else np.empty(0, np.uint32) for x in texts.column("links").to_pylist()]
        kept = texts.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
        kept = kept.add_column(5, "n_best", pa.array([int(tops[x].sum()) for x in links], pa.int64()))
        return kept.add_column(6, "count_sum", pa.array([int(counts[x].sum()) for x in links], pa.int64()))

    return settle


def digests(rows: DataFrame) -> DataFrame:
    """One row per text: counts, the digest of its groups, and how common its links are in the corpus.

    At most one number per id of B comes to the driver (``best``), a bound set by the vocabulary.
    """
    by_pair = Window.partitionBy("pair")
    totals = stored(block_pairs(rows).select(
        "block", F.col("at"), F.col("pair").bitwiseAND((1 << _SPLIT) - 1).alias("b_id"), F.sum("n").over(by_pair).alias("total")))
    tops = totals.groupBy("b_id").agg(F.max("total").alias("top")).toArrow().to_pydict()
    best = np.zeros(max(tops["b_id"], default=-1) + 1, np.int64)
    best[tops["b_id"]] = tops["top"]
    return rows.filter("pos IS NOT NULL").groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_settler(best), RESULT)


def _grouper(pair: Pair, chars: int, lane: int):
    def group(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _loaded(pair)
        sizes = tuple(np.array([len(p) for p in side.pieces]) for side in (a, b))
        for ids, texts in blocks_of(batches, chars):
            block = block_of(texts, a, b, sizes, lane)
            first = lambda n: np.cumsum(n) - n
            parts = lambda x, n: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(x, pa.int32()))
            yield pa.record_batch([
                pa.array(ids, pa.int64()), parts(block.a, block.n_a), parts(block.b, block.n_b),
                parts(block.a_cut - np.repeat(first(block.n_a), block.n_groups), block.n_groups),
                parts(block.b_cut - np.repeat(first(block.n_b), block.n_groups), block.n_groups)],
                names=[x.split()[0] for x in GROUPS.split(", ")])

    return group


def groups(docs: DataFrame, pair: Pair, chars: int = BLOCK_CHARS, lane: int = LANE) -> DataFrame:
    """Ids of both sides and, for each group, the place of its last A and its last B token."""
    return docs.select("doc_id", "text").mapInArrow(_grouper(pair, chars, lane), GROUPS)
