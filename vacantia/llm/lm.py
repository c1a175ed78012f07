"""LM scoring: logistic mixing of hashed-context bit predictors over bytes, and a unigram base score.

A text is its UTF-8 bytes and one end mark (0xFF, which no UTF-8 text holds). Each byte is eight
binary decisions. For each of the orders 0 to 4, a predictor tells how often the decision fell either
way after the same preceding bytes. A gate (how much the two longest contexts have been seen, and which
bit it is) picks a vector of weights; the predictors' log-odds are summed by it, and the outcome is
refined by a table of what such predictions came true to. Everything is learned from all training rows,
and what is gathered grows with them: the count of every different run of five bytes is kept, in a table
dealt by the two bytes before the last, so that all runs after the same two, three or four bytes stand
in one task, which counts their decisions exactly. Orders 0 and 1 have 65,792 different decisions
at most, which every task gets. The mixer is trained online through each task's runs, leaving out the
occurrence that is being predicted, and the tasks' weights are averaged. Scoring uses the finished
model, so that a text's score depends on no other row. A byte's cost is a function of five bytes: it is
computed once for each different run of five in the scored rows, met with the training's table. The
``HEAD_RUNS`` most frequent runs' costs are broadcast; a text's other runs meet theirs in a join.

The base score needs each word's count in the training rows. The ``HEAD`` most frequent words are
broadcast; a text's other words meet their counts in a join.

Defined cases: null counts as the empty text, which has its end only; a null doc_id is in no
held-out part and is trained on; repeated rows train repeatedly and score alike; without training
rows N and V are 0 and the predictors know nothing; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.stored import stored
from vacantia.llm.words import mix, word_hashes

#: Orders, words and runs broadcast at most, text taken together, different runs in a task.
ORDERS = 5
HEAD = 1 << 18
HEAD_RUNS = 1 << 20
BLOCK = 4_000_000
RUNS_A_TASK = 1 << 16
#: Times the mixer goes through a task's runs.
PASSES = 3
PARTS, LEFT_OUT = 7, 2
END = 0xFF
_PAD = bytes([END]) * 4
GATES, INPUTS, LEVELS = 16, ORDERS + 1, 33
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: The hash that stands for the end of a text among the words.
END_WORD = 0x5EED_0F_7E97


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % PARTS


def text_blocks(texts: list[str | None]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1]) + 4
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of four bytes and the byte after them, as numbers, with each text's first place and its end."""
    data = np.frombuffer(_PAD + b"".join([t + _PAD for t in texts]), np.uint8).astype(np.uint64)
    runs = data[4:].copy()
    for k in range(1, 5):
        runs |= data[4 - k : len(data) - k] << np.uint64(8 * k)
    sizes = np.array([len(t) + 4 for t in texts])
    first = np.cumsum(sizes) - sizes
    return runs, first, first + sizes - 3


def real(runs: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Without what stands between texts."""
    keep = np.ones(len(runs), bool)
    for k in range(3):
        keep[stop + k] = False
    return runs[keep]


def decisions(runs: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The number of each of the eight decisions after its context, and its outcome."""
    byte = (runs & np.uint64(255)).astype(np.int64)
    context = ((runs >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)).astype(np.int64)
    for j in range(8):
        yield context << 8 | (1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1


@dataclass
class Mixer:
    low: list[tuple[np.ndarray, np.ndarray]]  # zeros and ones of the decisions of orders 0 and 1
    weights: np.ndarray  # (8, GATES, INPUTS)
    refined: np.ndarray  # (256, LEVELS) chances


@dataclass
class Model:
    mixer: Mixer
    runs: DataFrame  # (key, a): every training run's count
    n_runs: int


def start_weights() -> np.ndarray:
    w = np.zeros((8, GATES, INPUTS))
    w[:, :, :ORDERS] = np.linspace(0.05, 0.5, ORDERS)
    return w


def fallen(mixer: Mixer, runs: np.ndarray, times: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each order and each of the eight decisions of the runs: how often it fell either way. Holds
    for the orders from 2 if all runs after the same two bytes are among ``runs``."""
    out = []
    for order in range(ORDERS):
        each = []
        for place, outcome in decisions(runs, order):
            if order < 2:
                zeros, ones = mixer.low[order]
            else:
                _, place = np.unique(place, return_inverse=True)
                ones = np.bincount(place, times * outcome)
                zeros = np.bincount(place, times) - ones
            each.append((zeros[place], ones[place]))
        out.append(each)
    return out


def inputs(runs: np.ndarray, counts: list[list[tuple[np.ndarray, np.ndarray]]], which: np.ndarray | slice,
           left_out: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each decision: log-odds of the predictors, gate, node and outcome. ``left_out``: as if not seen this once."""
    part = runs[which]
    for j, (node, outcome) in enumerate(decisions(part, 0)):
        x = np.ones((INPUTS, len(part)))
        seen = []
        for order in range(ORDERS):
            zeros, ones = (c[which] for c in counts[order][j])
            if left_out:
                ones, zeros = np.maximum(ones - outcome, 0), np.maximum(zeros - (1 - outcome), 0)
            x[order] = np.log((ones + 0.02) / (zeros + 0.02))
            seen.append(ones + zeros)
        gate = np.searchsorted([1, 4, 32], seen[-1], side="right") * 4 + np.searchsorted([1, 4, 32], seen[-2], side="right")
        yield x, gate, node, outcome


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-odds.clip(-20, 20)))


def _level(odds: np.ndarray) -> np.ndarray:
    return ((odds.clip(-8, 8) + 8) * ((LEVELS - 1) / 16) + 0.5).astype(np.int64)


def trained(runs: np.ndarray, times: np.ndarray, counts: list[list[tuple[np.ndarray, np.ndarray]]], weights: np.ndarray,
            steps: int, rate: float = 0.1) -> int:
    """Moves ``weights`` through the runs, part by part. Returns the steps made so far."""
    # in an order that isn't that of the bytes
    order = np.argsort(mix(runs))
    for a in range(0, len(runs), 4096):
        which = order[a : a + 4096]
        share = times[which]
        for j, (x, gate, _, outcome) in enumerate(inputs(runs, counts, which, True)):
            miss = share * (outcome - _chance((weights[j, gate].T * x).sum(0)))
            total = np.bincount(gate, share, GATES) + 1e-9
            for i in range(INPUTS):
                weights[j, :, i] += rate * np.bincount(gate, miss * x[i], GATES) / total / (1 + steps / 50) ** 0.5
        steps += 1
    return steps


def _costs(mixer: Mixer, runs: np.ndarray, times: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """-log10 of the chance of the last byte of the runs at ``wanted``."""
    out = np.zeros(len(wanted))
    counts = fallen(mixer, runs, times)
    for a in range(0, len(wanted), 65536):
        for j, (x, gate, node, outcome) in enumerate(inputs(runs, counts, wanted[a : a + 65536], False)):
            odds = (mixer.weights[j, gate].T * x).sum(0)
            p = (_chance(odds) + mixer.refined[node, _level(odds)]) / 2
            p = p.clip(1 / 65536, 1 - 1 / 65536)
            out[a : a + 65536] -= np.log10(np.where(outcome == 1, p, 1 - p))
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of a task, with how often they stand in the training rows and in the others."""
    held = list(batches)
    column = lambda name: np.concatenate([b.column(name).to_numpy() for b in held]) if held else np.empty(0, np.int64)
    return column("key").view(np.uint64), column("a").astype(float), column("t")


def dealt(runs: DataFrame, n: int) -> DataFrame:
    """Runs after the same two bytes in one task."""
    return runs.repartition(n // RUNS_A_TASK + 1, F.shiftright("key", 8).bitwiseAND(0xFFFF))


def priced(model: Model, asked: DataFrame, n: int) -> DataFrame:
    """(key, cost, t) of the n different runs (key, t)."""
    shipped = asked.sparkSession.sparkContext.broadcast(model.mixer)
    none = F.lit(0).cast("long")
    both = model.runs.select("key", "a", none.alias("t")).union(asked.select("key", none.alias("a"), "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, times, t = _whole(batches)
        wanted = np.flatnonzero(t)
        cost = _costs(shipped.value, runs, times, wanted)
        for a in range(0, len(wanted), 100_000):
            at = wanted[a : a + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs[at].view(np.int64)), pa.array(cost[a : a + 100_000]), pa.array(t[at])], ["key", "cost", "t"])

    return dealt(both.groupBy("key").agg(F.sum("a").alias("a"), F.sum("t").alias("t")), model.n_runs + n).mapInArrow(
        run, "key long, cost double, t long")


def costs(model: Model, runs: np.ndarray) -> np.ndarray:
    """-log10 of the chance of each run's last byte."""
    keys, back = np.unique(runs, return_inverse=True)
    asked = model.runs.sparkSession.createDataFrame(pa.table({"key": keys.view(np.int64), "t": np.ones(len(keys), np.int64)}))
    got = priced(model, asked, len(keys)).toArrow()
    out = np.empty(len(keys))
    out[np.searchsorted(keys, got.column("key").to_numpy().view(np.uint64))] = got.column("cost").to_numpy()
    return out[back]


class Costs:
    """What the runs broadcast cost, kept in a hashed table of fixed size; not a number for the others."""

    def __init__(self, runs: np.ndarray, values: np.ndarray, bits: int = 21) -> None:
        self.known, self.cost, self.shift = runs, values, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, np.uint64(0xFFFF_FFFF_FFFF_FFFF))
        self.values = np.zeros(1 << bits)

    def of(self, runs: np.ndarray) -> np.ndarray:
        place = ((runs * _SPREAD) >> self.shift).astype(np.int64)
        out = self.values[place]
        other = np.flatnonzero(self.keys[place] != runs)
        if len(other):
            new, back = np.unique(runs[other], return_inverse=True)
            cost = np.full(len(new), np.nan)
            at = np.searchsorted(self.known, new)
            at[at == len(self.known)] = 0
            if len(self.known):
                cost = np.where(self.known[at] == new, self.cost[at], np.nan)
            out[other] = cost[back]
            place = ((new * _SPREAD) >> self.shift).astype(np.int64)
            self.keys[place], self.values[place] = new, cost
        return out


def _rows(kind: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(keys), 100_000):
        k = keys[a : a + 100_000]
        columns = [np.full(len(k), kind, np.int8), k.view(np.int64), counts[a : a + 100_000].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "a"])


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes(b"\n".join([b" ".join(t.lower().split()) for t in texts]))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([c for _, c in parts]), len(keys))


def _counted(batches: Iterator[pa.RecordBatch], words: bool = True) -> Iterator[pa.RecordBatch]:
    """Rows (0, run, count) and (1, word, count), summed in the task as far as they fit."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 1: []}
    seen = 0

    def emptied(kind: int, keep: int = 0) -> Iterator[pa.RecordBatch]:
        if held[kind]:
            keys, counts = _merged(held[kind])
            held[kind] = [(keys, counts)] if len(keys) <= keep else []
            if not held[kind]:
                yield from _rows(kind, keys, counts)

    for batch in batches:
        for texts in text_blocks(batch.column("text").to_pylist()):
            seen += len(texts)
            for kind, keys in ((0, real(*grams(texts))), *([(1, _words(texts)[0])] if words else [])):
                keys, counts = np.unique(keys, return_counts=True)
                held[kind].append((keys, counts.astype(float)))
                if sum(len(k) for k, _ in held[kind]) > 3_000_000:
                    yield from emptied(kind, 1_500_000)
    if seen and words:
        held[1].append((np.array([END_WORD], np.uint64), np.array([float(seen)])))
    yield from emptied(0)
    yield from emptied(1)


@dataclass
class Counts:
    model: Model
    words: DataFrame  # (key, a): every training word's count
    n: int
    v: int


def learned(training: DataFrame) -> Counts:
    """The model and the word counts of all training rows."""
    spark = training.sparkSession
    rows = training.select("text").mapInArrow(_counted, "kind byte, key long, a long")
    sums = stored(rows.groupBy("kind", "key").agg(F.sum("a").alias("a")))
    words = sums.filter("kind = 1").select("key", "a")
    total = words.agg(F.count("*").alias("v"), F.sum("a").alias("n")).first()
    runs = sums.filter("kind = 0").select("key", "a")
    pairs = runs.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.count("*").alias("n"), F.sum("a").alias("a")).toArrow()  # 65,536 at most
    low = []
    for order in range(2):
        zeros, ones = np.zeros(1 << 8 * (order + 1)), np.zeros(1 << 8 * (order + 1))
        for place, outcome in decisions(pairs.column("key").to_numpy().view(np.uint64), order):
            np.add.at(ones, place, pairs.column("a").to_numpy() * outcome)
            np.add.at(zeros, place, pairs.column("a").to_numpy() * (1 - outcome))
        low.append((zeros, ones))
    mixer = Mixer(low, start_weights(), np.empty(0))
    model = Model(mixer, runs, int(pairs.column("n").to_numpy().sum()))
    shipped = spark.sparkContext.broadcast(mixer)

    def tuned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, times, _ = _whole(batches)
        if not len(runs):
            return
        weights, steps, share = start_weights(), 0, times.sum()
        hits = np.zeros((256 * LEVELS, 2))
        counts = fallen(shipped.value, runs, times)
        for _ in range(PASSES):
            steps = trained(runs, times, counts, weights, steps)
        for a in range(0, len(runs), 65536):
            which = slice(a, a + 65536)
            for j, (x, gate, node, outcome) in enumerate(inputs(runs, counts, which, True)):
                cell = node * LEVELS + _level((weights[j, gate].T * x).sum(0))
                hits[:, 1] += np.bincount(cell, times[which] * outcome, len(hits))
                hits[:, 0] += np.bincount(cell, times[which] * (1 - outcome), len(hits))
        flat = weights.reshape(-1) * share
        place = np.concatenate((np.arange(len(flat)), len(flat) + np.arange(hits.size), [-1]))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.concatenate((flat, hits.reshape(-1), [share])))], ["place", "value"])

    tuning = dealt(runs.withColumn("t", F.lit(0)), model.n_runs).mapInArrow(tuned, "place long, value double").groupBy("place").agg(
        F.sum("value").alias("value")).toArrow()
    found = dict(zip(tuning.column("place").to_pylist(), tuning.column("value").to_pylist(), strict=True))
    size = mixer.weights.size
    hits = np.array([found.get(size + i, 0.0) for i in range(256 * LEVELS * 2)]).reshape(256, LEVELS, 2)
    centre = _chance(np.linspace(-8, 8, LEVELS))[None, :]
    mixer.refined = (hits[:, :, 1] + 50 * centre) / (hits.sum(2) + 50)
    if found.get(-1):
        mixer.weights = np.array([found[i] for i in range(size)]).reshape(mixer.weights.shape) / found[-1]
    return Counts(model, words, int(total["n"] or 0), int(total["v"] or 0))


def _head(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent runs, in order, and their costs: as many levels of frequency as have ``HEAD_RUNS`` at most."""
    level = F.floor(F.log2("t") * 8)
    left, least = HEAD_RUNS, None
    for row in sorted(table.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        left -= row["n"]
        if left < 0:
            break
        least = row["level"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0)
    got = table.filter(level >= least).select("key", "cost").toArrow()
    keys = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], got.column("cost").to_numpy()[order]


def scored(docs: DataFrame, counts: Counts) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    top = counts.words.orderBy(F.desc("a"), "key").limit(HEAD).toArrow()
    keys = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    asked = stored(docs.select("text").mapInArrow(lambda batches: _counted(batches, False), "kind byte, key long, a long").groupBy("key").agg(
        F.sum("a").alias("t")))
    table = stored(priced(counts.model, asked, asked.count()))
    shipped = spark.sparkContext.broadcast((_head(table), keys[order], np.log10(top.column("a").to_numpy()[order] + 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_runs, keys, logs = shipped.value
        kept = Costs(*known_runs)
        for batch in batches:
            scores, sizes, known, sums, rest, rare = [], [], [], [], [], []
            for texts in text_blocks(batch.column("text").to_pylist()):
                runs, first, stop = grams(texts)
                cost = kept.of(runs)
                cuts = np.column_stack((first, stop)).reshape(-1)
                unknown = np.flatnonzero(np.isnan(cost))
                cost[unknown] = 0.0
                # those between texts have no row of their own
                far = runs[unknown].view(np.int64)
                at = np.searchsorted(unknown, cuts)
                rare += [far[a:b] for a, b in zip(at[::2], at[1::2], strict=True)]
                scores.append(-np.add.reduceat(np.append(cost, 0.0), cuts)[::2])
                words, owner = _words(texts)
                words = np.concatenate((words, np.full(len(texts), END_WORD, np.uint64)))
                owner = np.concatenate((owner, np.arange(len(texts))))
                at = np.searchsorted(keys, words).clip(max=max(0, len(keys) - 1))
                head = keys[at] == words if len(keys) else np.zeros(len(words), bool)
                sizes.append(np.bincount(owner, minlength=len(texts)))
                known.append(np.bincount(owner[head], minlength=len(texts)))
                sums.append(np.bincount(owner[head], logs[at[head]] if len(keys) else None, len(texts)))
                other, owner = words[~head], owner[~head]
                turn = np.argsort(owner, kind="stable")
                ends = np.searchsorted(owner[turn], np.arange(len(texts) + 1))
                other = other[turn].view(np.int64)
                rest += [other[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            join = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.empty(0, kind))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), join(sizes, np.int64), join(known, np.int64),
                 join(sums, np.float64), join(scores, np.float64), pa.array(rest, pa.list_(pa.int64())),
                 pa.array(rare, pa.list_(pa.int64()))],
                ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "score", "rest", "rare"])

    ids = F.col("doc_id").cast("long")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), ids.alias("doc_id"),
        F.coalesce(remainder(ids) == LEFT_OUT, F.lit(False)).alias("held_out"), "text")
    first = stored(rows.mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, rest array<long>, rare array<long>"))
    met = first.select("row", F.explode("rest").alias("key")).join(counts.words, "key")
    tail = met.groupBy("row").agg(F.count("*").alias("k"), F.sum(F.log10(F.col("a") + 1.0)).alias("l"))
    cost = first.select("row", F.explode("rare").alias("key")).join(table, "key").groupBy("row").agg(F.sum("cost").alias("cost"))
    whole = F.lit(float(np.log10(counts.n + counts.v + 1)))
    return first.join(tail, "row", "left").join(cost, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(counts.n).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("l", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("score") - F.coalesce("cost", F.lit(0.0))).alias("score"))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.coalesce(remainder(F.col("doc_id").cast("long")) != LEFT_OUT, F.lit(True)))
