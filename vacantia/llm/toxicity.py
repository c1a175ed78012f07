"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

A text's terms are its words (lower case, ASCII punctuation cut off) and their stems of 4 and 6
bytes, each once. From labelled rows, a bounded sample with at most ``TOXIC_ROWS`` and
``CLEAN_ROWS`` rows by hash of their id, in which each class weighs what it does in all training labels, terms that tell the classes apart become voters: a lexicon
voter is a word, a pattern voter a stem ("any word that begins so"). These vote toxic or abstain, and
one more voter votes clean where all of them abstain; the row's own label is the last voter.

The label model is generative: a hidden label, and for each voter the chance of a vote under either
label, fitted by expectation maximisation; an abstention says nothing. Voters that vote together more
than their labels explain are correlated; a voter's evidence is divided by the sum of its squared
correlations with all voters, so a word and its own stem count about once. The posterior labels train a logistic regression over all
telling terms, which scores every whole text; labels, language, source and id are no inputs.

Defined cases: null and blank texts have no terms and get the classifier's base rate; repeated rows
score alike; without labelled rows, or with one class only, every score is that class's share of
the labels (0 if there are none); an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.stored import stored
from vacantia.llm.words import BLOCK_BYTES, mix
from vacantia.llm.words import _BYTE as BYTE
from vacantia.llm.words import _PLACE as PLACE

#: Bounds of the sample of labelled rows, and of what is learned from it.
TOXIC_ROWS, CLEAN_ROWS, TERMS, VOTERS = 4_000, 8_000, 4_096, 200
STEMS = (4, 6)
#: How often a given label is taken to be right.
LABEL_RIGHT = 0.9
HELD_OUT = 5
_CUT = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\r\x0b\x0c", b" " * 36)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def remainder(doc_id: Column, parts: int = HELD_OUT) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def term_hashes(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, text) for blocks of texts: the hash of every term and its text's place."""
    held: list[bytes] = []
    size = first = 0
    for at, text in enumerate(texts, 1):
        held.append((text or "").lower().encode("utf-8", "surrogatepass").replace(b"\n", b" ").translate(_CUT))
        size += len(held[-1])
        if size >= BLOCK_BYTES or at == len(texts):
            yield first, at, *_terms(b"\n".join(held))
            held, size, first = [], 0, at


def _terms(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(block, np.uint8)
    gap = (data == 32) | (data == 10)
    inside = ~gap
    starts = np.flatnonzero(inside & np.concatenate(([True], gap[:-1])))
    if not len(starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    lengths = np.flatnonzero(inside & np.concatenate((gap[1:], [True]))) + 1 - starts
    letters = data[inside]
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(firsts, lengths)
    value = BYTE[letters] * PLACE[place & 4095]
    owner = np.searchsorted(np.flatnonzero(data == 10), starts)
    found, owners = [mix(np.add.reduceat(value, firsts) + lengths.astype(np.uint64))], [owner]
    for n in STEMS:
        longer = lengths > n
        cut = np.add.reduceat(np.where(place < n, value, np.uint64(0)), firsts)[longer]
        found.append(mix(cut + np.uint64(1000 + n)))
        owners.append(owner[longer])
    return np.concatenate(found), np.concatenate(owners)


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of all training rows."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(remainder(F.col("doc_id")) != 0)
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def sample(labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> DataFrame:
    """(doc_id, toxic) of training rows, so many of each class at most."""
    known = training_labels(labels)
    part = lambda value, rows: known.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return part(1, toxic_rows).union(part(0, clean_rows))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms: list[np.ndarray] = []
        for first, last, hashes, owner in term_hashes(batch.column("text").to_pylist()):
            order = np.argsort(owner, kind="stable")
            cuts = np.searchsorted(owner[order], np.arange(last - first + 1))
            terms += [np.unique(hashes[order[a:b]]).view(np.int64) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("toxic"), pa.array(terms, pa.list_(pa.int64()))], ["doc_id", "toxic", "terms"])


@dataclass
class Model:
    keys: np.ndarray  # sorted term hashes
    weights: np.ndarray
    bias: float


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 15, weight: np.ndarray | None = None) -> np.ndarray:
    """Posterior chance of the label being 1 for each row of a 0/1 vote matrix, whose rows count ``weight`` times."""
    votes = np.column_stack((votes, votes.sum(1) == 0))  # the voter for clean
    chance = start.astype(float)
    weight = np.ones(len(votes)) if weight is None else weight
    n, m = weight.sum(), votes.shape[1]
    evidence = np.ones(m)
    for turn in range(rounds):
        part1, part0 = weight * chance, weight * (1 - chance)
        ones, zeros = part1.sum(), n - part1.sum()
        rate1 = (part1 @ votes + 0.5) / (ones + 1)
        rate0 = (part0 @ votes + 0.5) / (zeros + 1)
        if turn == rounds // 3:
            # what is left of the votes once the labels are known
            left = votes - (chance[:, None] * rate1 + (1 - chance)[:, None] * rate0)
            spread = np.sqrt(weight @ left**2 / n) + 1e-9
            related = ((left.T @ (left * weight[:, None])) / n / spread[:, None] / spread[None, :]) ** 2
            evidence[:-1] = 1 / related[:-1, :-1].sum(0).clip(1)
        odds = np.log(ones + 1) - np.log(zeros + 1) + votes @ (evidence * np.log(rate1 / rate0))
        odds = odds + (2 * start - 1) * np.log(LABEL_RIGHT / (1 - LABEL_RIGHT))
        chance = 1 / (1 + np.exp(-odds.clip(-30, 30)))
    return chance


def regression(rows: np.ndarray, columns: np.ndarray, shape: tuple[int, int], goal: np.ndarray, weight: np.ndarray,
               ridge: float = 0.3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features at (rows, columns) for soft goals, by Adam."""
    n, m = shape
    w, total = np.zeros(m + 1), weight.sum()
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    w[m] = np.log((weight @ goal + 0.5) / (total - weight @ goal + 0.5))
    for t in range(1, steps + 1):
        margin = np.bincount(rows, w[columns], n) + w[m]
        miss = weight * (1 / (1 + np.exp(-margin.clip(-30, 30))) - goal) / total
        slope = np.append(np.bincount(columns, miss[rows], m) + ridge / n * w[:m], miss.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        w = w - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return w[:m], float(w[m])


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier, from the bounded sample of labelled rows."""
    chosen = sample(labels)
    # a class cut to its bound counts as often as in all training labels
    share = dict.fromkeys((0, 1), 1.0)
    for rows, sign in ((training_labels(labels), 1), (chosen, -1)):
        for row in rows.filter("toxic IN (0, 1)").groupBy("toxic").count().collect():
            share[row["toxic"]] *= float(row["count"]) ** sign
    chosen = F.broadcast(chosen)  # TOXIC_ROWS + CLEAN_ROWS rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id")
    seen = stored(texts.mapInArrow(_sets, "doc_id long, toxic int, terms array<long>"))
    sums = seen.agg(F.count("*").alias("n"), F.sum("toxic").alias("n1")).first()
    n, n1 = int(sums["n"]), int(sums["n1"] or 0)
    if not 0 < n1 < n:
        return Model(np.empty(0, np.uint64), np.empty(0), 30.0 if n1 else -30.0)
    n0 = n - n1
    even = n / (n1 * share[1] + n0 * share[0])
    heavy1, heavy0 = even * share[1], even * share[0]
    base = float(np.log((n1 * heavy1 + 0.5) / (n0 * heavy0 + 0.5)))
    counts = seen.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum("toxic").alias("k1"), (F.count("*") - F.sum("toxic")).alias("k0"))
    r1, r0 = (F.col("k1") + 0.5) / (n1 + 1), (F.col("k0") + 0.5) / (n0 + 1)
    spread = F.sqrt((F.col("k1") + F.col("k0") + 1.0) / (n + 2) * (1 - (F.col("k1") + F.col("k0") + 1.0) / (n + 2)) * (1 / n1 + 1 / n0))
    terms = (
        counts.filter(F.col("k1") + F.col("k0") >= max(3, n // 1000)).withColumn("z", (r1 - r0) / spread)
        .orderBy(F.abs("z").desc(), "term").limit(TERMS).collect())
    if not terms:
        return Model(np.empty(0, np.uint64), np.empty(0), base)
    # a voter: frequent among toxic rows, rare among the others
    odds = lambda t: ((t["k1"] + 0.5) / (n1 + 1)) / ((t["k0"] + 0.5) / (n0 + 1))
    voters = [t["term"] for t in terms if odds(t) >= 8 and t["k1"] >= max(3, 0.01 * n1)][:VOTERS]
    keys = np.sort(np.array([t["term"] for t in terms], np.int64).view(np.uint64))
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(int(k),) for k in keys.view(np.int64)], "term long"))
    rows, columns, gold = _matrix(seen, wanted, keys)
    if not len(gold):
        return Model(np.empty(0, np.uint64), np.empty(0), base)
    place = np.full(len(keys), -1)
    place[np.searchsorted(keys, np.array(voters, np.int64).view(np.uint64))] = np.arange(len(voters))
    votes = np.zeros((len(gold), max(1, len(voters))))
    cast = place[columns] >= 0
    votes[rows[cast], place[columns[cast]]] = 1
    weight = np.where(gold == 1, heavy1, heavy0)
    goal = label_model(votes, gold, weight=weight) if voters else gold.astype(float)
    weights, bias = regression(rows, columns, (len(gold), len(keys)), goal, weight)
    return Model(keys, weights, bias)


def _matrix(seen: DataFrame, wanted: DataFrame, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the wanted terms in the sampled rows, and the rows' labels."""
    found = seen.select("doc_id", "toxic", F.explode_outer("terms").alias("term")).join(wanted.withColumn("hit", F.lit(1)), "term", "left")
    got = found.groupBy("doc_id", "toxic").agg(F.collect_list(F.when(F.col("hit") == 1, F.col("term"))).alias("terms")).orderBy("doc_id").collect()
    gold = np.array([r["toxic"] for r in got])
    rows = np.repeat(np.arange(len(got)), [len(r["terms"]) for r in got])
    terms = np.array([t for r in got for t in r["terms"]], np.int64).view(np.uint64)
    return rows, np.searchsorted(keys, terms), gold


def _score(texts: list[str | None], model: Model, mask: np.ndarray) -> np.ndarray:
    margins = np.full(len(texts), model.bias)
    for first, last, hashes, owner in term_hashes(texts):
        maybe = np.flatnonzero(mask[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(maybe):
            continue
        at = np.searchsorted(model.keys, hashes[maybe]).clip(max=len(model.keys) - 1)
        real = model.keys[at] == hashes[maybe]
        pair = np.unique(owner[maybe][real] * len(model.keys) + at[real])  # a term counts once a text
        margins[first:last] += np.bincount(pair // len(model.keys), model.weights[pair % len(model.keys)], last - first)
    return 1 / (1 + np.exp(-margins.clip(-30, 30)))


def _mask(model: Model) -> np.ndarray:
    mask = np.zeros(1 << 20, bool)
    mask[(model.keys >> np.uint64(44)).astype(np.int64)] = True
    return mask


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = _mask(model)
        for batch in batches:
            score = _score(batch.column("text").to_pylist(), model, mask)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    ids = F.col("doc_id").cast("long")
    return docs.select(ids.alias("doc_id"), F.coalesce(remainder(ids) == 0, F.lit(False)).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, columns unchanged."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = _mask(model)
        for batch in batches:
            yield batch.filter(pa.array(_score(batch.column(at).to_pylist(), model, mask) < 0.5))

    return docs.mapInArrow(run, docs.schema)
