"""Grouping of spelling variants: words one edit apart, found by composing automata.

The vocabulary is dealt into cells. Two words that differ by one edit agree either before or behind the
middle of the shorter one, so each word goes into a cell with its first half and a cell with its second
half (once as the shorter, once as the longer word of a pair): what a cell's words share is the state all
of them start from, what they don't share is their region. Cells that grow too large are halved again, by
the same rule, on the region alone; so no cell grows with the corpus and no word is left out.

In a cell the regions are built into minimised acceptors, one of the shorter and one of the longer words,
and composed with a transducer of exactly one edit that takes its edit where the two words first differ:
a walk over states both read alike, then one replaced or inserted letter, then a walk over letters common to
both states. As the first difference of a pair lies in one place, each pair is accepted once, in one cell.

Defined cases: texts that are null or without letters give no words; a null doc_id alters no run; repeated
rows count like other rows; without a word of the lowest count or length the result is empty; runs of any
length are words; ties of the largest count go to the smaller word in code-point order.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.stored import stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH = 7
LEAST_COUNT = 2
FACTOR = 10
#: One letter of a run goes where this divides the run's checksum.
DROP = 31
#: Distinct words a task counts before it hands them on.
HELD_WORDS = 400_000
#: Rows of a cell beyond which it is halved again.
CELL_ROWS = 20_000


# --- the vocabulary

def runs_of(doc_id: int | None, text: str | None) -> Counter:
    """The runs of one text after the lower-casing of A-Z and the dropped letters, counted."""
    if not text:
        return Counter()
    runs = Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    if doc_id is None:
        return runs
    out: Counter = Counter()
    start = zlib.crc32(b"%d:" % doc_id)
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % DROP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def _counter(least: int):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in runs_of(doc_id, text).items():
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield pa.record_batch([list(held), list(held.values())], names=["word", "n"])
                    held.clear()
        yield pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    return count


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least so many code points and occurrences, written once."""
    counted = docs.select("doc_id", "text").mapInArrow(_counter(least_length), "word string, n long")
    return stored(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count))


# --- cells

def _halves(rows: DataFrame) -> DataFrame:
    """Each row in the cell of the first and the cell of the second half of its region.

    A cell has pairs of a word of ``m`` letters and one of as many (or, ``longer``, one letter more) that
    first differ at lo to hi - 1 (or at hi, where ``last``): up to lo and from hi on they agree.
    """
    more = F.col("longer").cast("int")
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    cut = lambda first, behind: F.substr("word", first + 1, behind - first)
    front = F.struct(mid.alias("lo"), "hi", "last", F.concat("head", cut(F.col("lo"), mid)).alias("head"), "tail")
    back = F.struct(
        "lo", mid.alias("hi"), F.lit(False).alias("last"), "head", F.concat(cut(mid + more, F.col("hi") + more), "tail").alias("tail"))
    return rows.select("word", "n", "m", "longer", F.explode(F.array(front, back)).alias("c")).select("word", "n", "m", "longer", "c.*")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cell", F.concat_ws("|", "m", "lo", "hi", "last", "head", "tail"))


def cells(words: DataFrame, least_length: int = LEAST_LENGTH, most: int = CELL_ROWS) -> DataFrame:
    """(cell, last, longer, region, word, n) of every word, no cell that can be halved above ``most`` rows."""
    size = F.length("word")
    start = lambda longer: words.select(
        "word", "n", (size - int(longer)).alias("m"), F.lit(longer).alias("longer"), F.lit(0).alias("lo"),
        (size - int(longer)).alias("hi"), F.lit(True).alias("last"), F.lit("").alias("head"), F.lit("").alias("tail"))
    open_rows = _keyed(_halves(start(False).unionByName(start(True).filter(F.col("m") >= least_length))))
    done = None
    while True:
        # a checksum is enough here: two cells taken for one are at worst halved for nothing
        tag = F.xxhash64("cell")
        large = stored(open_rows.filter(F.col("hi") - F.col("lo") > 1).groupBy(tag.alias("tag")).count().filter(F.col("count") > most).select("tag"))
        if large.isEmpty():
            break
        splits = F.col("hi") - F.col("lo") > 1
        tagged = open_rows.withColumn("tag", tag)
        small = tagged.join(large, "tag", "left_anti").unionByName(tagged.filter(~splits).join(large, "tag", "left_semi"))
        done = small if done is None else done.unionByName(small)
        open_rows = stored(_keyed(_halves(tagged.filter(splits).join(large, "tag", "left_semi"))))
    every = open_rows if done is None else done.drop("tag").unionByName(open_rows)
    region = F.substr("word", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("longer").cast("int"))
    return every.select("cell", "last", "longer", region.alias("region"), "word", "n")


# --- automata

class Acceptor:
    """The minimised acyclic acceptor of sorted distinct words; state 0 is where it starts."""

    def __init__(self, words: Iterable[str]) -> None:
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        self._known: dict[tuple, int] = {}
        path, read = [0], ""
        for word in words:
            same = 0
            while same < len(read) and same < len(word) and read[same] == word[same]:
                same += 1
            self._settle(path, read, same)
            for letter in word[same:]:
                self.arcs[path[-1]][letter] = len(self.arcs)
                path.append(len(self.arcs))
                self.arcs.append({})
                self.final.append(False)
            self.final[path[-1]] = True
            read = word
        self._settle(path, read, 0)

    def _settle(self, path: list[int], read: str, depth: int) -> None:
        """States of the path beyond ``depth`` won't change: each is replaced by its equal, if there is one."""
        while len(path) > depth + 1:
            state = path.pop()
            equal = self._known.setdefault((self.final[state], *self.arcs[state].items()), state)
            if equal != state:
                self.arcs[path[-1]][read[len(path) - 1]] = equal


def shared(a: Acceptor, p: int, b: Acceptor, q: int, not_first: str = "") -> Iterator[str]:
    """Words accepted from state p of ``a`` and from state q of ``b`` that don't begin with ``not_first``."""
    letters: list[str] = []
    ahead = [(p, q, 0, "")]
    while ahead:
        p, q, depth, letter = ahead.pop()
        if depth:
            letters[depth - 1 :] = [letter]
        if a.final[p] and b.final[q]:
            yield "".join(letters[:depth])
        arcs = b.arcs[q]
        for letter, to in a.arcs[p].items():
            if letter in arcs and (depth or letter != not_first):
                ahead.append((to, arcs[letter], depth + 1, letter))


def alike(a: Acceptor, b: Acceptor) -> Iterator[tuple[int, int, str]]:
    """The composition before its edit: states both reach by the same letters, and the letters."""
    letters: list[str] = []
    ahead = [(0, 0, 0, "")]
    while ahead:
        p, q, depth, letter = ahead.pop()
        if depth:
            letters[depth - 1 :] = [letter]
        arcs = b.arcs[q]
        for letter, to in a.arcs[p].items():
            if letter in arcs:
                ahead.append((to, arcs[letter], depth + 1, letter))
        yield p, q, "".join(letters[:depth]) if len(a.arcs[p]) > 1 or b.arcs[q] else ""


def one_edit(shorter: list[str], longer: list[str], last: bool) -> Iterator[tuple[str, str, bool]]:
    """(region, region, whether the second is of a longer word) of all pairs one edit apart.

    Regions of shorter words are all of one length, those of longer words one letter longer. ``last``
    says whether a letter may be inserted behind the end; if not, that pair belongs to another cell.
    """
    one = Acceptor(sorted(shorter))
    for p, _, read in alike(one, one):
        for (a, to_a), (b, to_b) in combinations(one.arcs[p].items(), 2):
            for rest in shared(one, to_a, one, to_b):
                yield read + a + rest, read + b + rest, False
    if not longer:
        return
    two = Acceptor(sorted(longer))
    for p, q, read in alike(one, two):
        for extra, to in two.arcs[q].items():
            for rest in shared(one, p, two, to, extra):
                if rest or last:
                    yield read + rest, read + extra + rest, True


def _cells_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bool, dict, dict]]:
    """(last, shorter, longer) of every cell of rows in order of cell; region to (word, n)."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for _, cell in groupby(rows, key=lambda row: row[0]):
        shorter, longer, last = {}, {}, False
        for _, last, is_longer, region, word, n in cell:
            (longer if is_longer else shorter)[region] = (word, n)
        if shorter and len(shorter) + len(longer) > 1:
            yield last, shorter, longer


def pairs_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], tuple[str, int]]]:
    for last, shorter, longer in _cells_of(batches):
        for u, v, inserted in one_edit(list(shorter), list(longer), last):
            yield shorter[u], (longer if inserted else shorter)[v]


def _near_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for (u, n_u), (v, n_v) in pairs_of(batches):
        held.append((u, v, n_u, n_v))
        if len(held) == 50_000:
            yield pa.record_batch([list(x) for x in zip(*held)], names=["a", "b", "n_a", "n_b"])
            held = []
    if held:
        yield pa.record_batch([list(x) for x in zip(*held)], names=["a", "b", "n_a", "n_b"])


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, n, near): of a task's pairs, the number for each word and its most frequent partner."""
    found: dict[str, tuple[int, int, str]] = {}

    def out() -> pa.RecordBatch:
        kinds = pa.string(), pa.int64(), pa.int64(), pa.string()
        columns = zip(*((w, n, -less, near) for w, (n, less, near) in found.items())) if found else ((), (), (), ())
        return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["word", "n_near", "n", "near"])

    for one, two in pairs_of(batches):
        for (word, _), (near, n) in ((one, two), (two, one)):
            count, *best = found.get(word, (0, 0, ""))
            found[word] = (count + 1, *min((-n, near), tuple(best)))
        if len(found) >= HELD_WORDS:
            yield out()
            found.clear()
    yield out()


def _by_cell(words: DataFrame, least_length: int, most: int) -> DataFrame:
    return cells(words, least_length, most).repartition("cell").sortWithinPartitions("cell")


def near_pairs(words: DataFrame, least_length: int = LEAST_LENGTH, most: int = CELL_ROWS) -> DataFrame:
    """(a, b, n_a, n_b): every pair of words one edit apart, once; ``b`` is the longer one, if one is."""
    return _by_cell(words, least_length, most).mapInArrow(_near_pairs, "a string, b string, n_a long, n_b long")


def variants(words: DataFrame, least_length: int = LEAST_LENGTH, most: int = CELL_ROWS, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word; ``words`` is read several times."""
    found = _by_cell(words, least_length, most).mapInArrow(_neighbours, "word string, n_near long, n long, near string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("best"))
    top = -F.col("best.less")
    taken = top >= factor * F.col("n")
    formed = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.near")).alias("form"), F.when(taken, top).alias("form_n")))
    # each round doubles how far a root lies from its word; counts grow by the factor, so there are few
    roots = formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = stored(roots.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if roots.filter("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return formed.join(roots.drop("moved"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
