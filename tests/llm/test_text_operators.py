"""Quality rules, toxicity, encoding, packing, license scans and LM scoring against plain versions."""
import base64
import collections
import gc
import hashlib
import math
import random
import re
import textwrap
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm.conftest import sentence
from vacantia.llm import bpe, licenses, lm, packing, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(n, int(n % 3 > 0), int(n % 5 == 0)) for n in range(10, 50)] + [(None, 1, 1), (11, None, None)], LABELS)


def bag(rows):
    return sorted(rows, key=repr)


# --- quality

def plain_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))


def test_quality_counts(spark, docs, labels, rows):
    more = ["a b c d e f g h " * 3, "x\nx\n\n \n \nx y", "#*$ %&|<> é🙂", "one " * 40, "\n".join(["l m n o p q r s t u"] * 4) + " z"]
    more = [(900 + i, t, "en", "a", 0) for i, t in enumerate(more)]
    table = docs.unionByName(spark.createDataFrame(more, docs.schema))
    ratios = quality.as_column(quality.log_ratios(table, quality.trusted_sample(labels)))
    got = quality.scored(table, ratios).collect()
    want = [(r[0], *plain_counts(r[1])) for r in [*rows, *more]]
    assert bag((g.doc_id, g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) for g in got) == bag(want)
    for g in got:
        assert g.base_failed == (g.n_words < 20 or 100 * g.n_repeat_words > 30 * g.n_words)
        assert g.kept == (not g.base_failed and g.llr >= quality.THRESHOLD)


def test_quality_ratio(docs, labels, rows):
    from pyspark.sql import functions as F

    table = quality.log_ratios(docs, quality.trusted_sample(labels))
    counted = quality.keyed(docs).select("doc_id", quality.grams(F.col("_keys"), F.col("_pairs")).alias("g")).collect()
    good = {n for n in range(10, 50) if n % 3 > 0}
    raw = collections.Counter(b for r in counted for b in r.g)
    target = collections.Counter(b for r in counted if r.doc_id in good for b in r.g)
    scale = sum(raw.values()) / sum(target.values())
    got = {r.bucket: r.ratio for r in table.collect()}
    assert got.keys() == raw.keys()
    for b in raw:
        assert got[b] == pytest.approx(math.log((target[b] * scale + 16) / (raw[b] + 16)), abs=1e-9)
    assert all(len(r.g) == max(0, 2 * len(WORD.findall(dict((x[0], x[1]) for x in rows)[r.doc_id] or "")) - 1) for r in counted)


def test_quality_reject_is_the_same_decision(docs, clashing, no_docs, labels):
    ratios = quality.as_column(quality.log_ratios(docs, quality.trusted_sample(labels)))
    kept = bag(r.doc_id for r in quality.scored(docs, ratios).filter("kept").collect())
    assert bag(r.doc_id for r in quality.reject(docs, ratios).collect()) == kept
    out = quality.reject(clashing, ratios)
    assert out.columns == clashing.columns and bag(r.doc_id for r in out.collect()) == kept
    assert {tuple(r)[5:] for r in out.collect()} == {(7,) * (len(out.columns) - 5)}
    assert quality.log_ratios(no_docs, quality.trusted_sample(labels)).count() == 0
    assert quality.scored(no_docs, ratios).count() == 0
    none = quality.log_ratios(docs, quality.trusted_sample(labels.limit(0)))
    assert {r.ratio for r in none.collect()} == {0.0}


def test_lm_keeps_all_contexts(spark):
    """What the model gathers grows with the texts: in 150,000 letters at random, seen twice, hardly a context is met by others."""
    rng = random.Random(31)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(150_000))
    table = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    bits = -lm.scored(table, lm.learned(table)).first().score / math.log10(2) / len(text)
    assert bits < 0.6


@pytest.mark.parametrize(("head", "a_task"), [(0, 300), (40, 1 << 16)])
def test_lm_runs_met_in_a_join(docs, monkeypatch, head, a_task):
    """Scores don't depend on how many runs are broadcast or how many stand in a task."""
    counts = lm.learned(lm.training_rows(docs))
    want = {r.doc_id: r.score for r in lm.scored(docs, counts).collect()}
    monkeypatch.setattr(lm, "HEAD_RUNS", head)
    monkeypatch.setattr(lm, "RUNS_A_TASK", a_task)
    got = {r.doc_id: r.score for r in lm.scored(docs, counts).collect()}
    assert got == {k: pytest.approx(v, rel=1e-9) for k, v in want.items()}


# --- toxicity

@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(5)
    texts, marks = [], []
    for n in range(600):
        words = ["".join(rng.choice(["ba", "do", "fi", "gu"]) for _ in range(3)) for _ in range(60)]
        if n % 4 == 0:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["Zounder", "grublet", "snarkwit,", "mumpel" + rng.choice("abcdefgh")])
        texts.append((n, " ".join(words), "en", "a", 1))
        if n % 3:
            marks.append((n, 1, int(n % 4 == 0)))
    return spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(marks, LABELS)


def test_toxicity_held_out(insults):
    table, marks = insults
    model = toxicity.learned(table, marks)
    got = toxicity.scored(table, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    wrong = sum(r.predicted != int(r.doc_id % 4 == 0) for r in got)
    assert wrong <= 0.03 * len(got)
    assert bag(r.doc_id for r in toxicity.clean(table, model).collect()) == bag(r.doc_id for r in got if not r.predicted)


def test_toxicity_hides_held_out_labels(insults):
    table, marks = insults
    from pyspark.sql import functions as F

    turned = marks.withColumn("toxic", F.when(toxicity.remainder(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.learned(table, marks), toxicity.learned(table, turned)
    assert one.bias == two.bias and (one.weights == two.weights).all()


def test_toxicity_cases(docs, clashing, no_docs, labels, insults):
    model = toxicity.learned(*insults)
    assert toxicity.scored(docs, model).count() == docs.count()
    blank = {r.score for r in toxicity.scored(docs, model).collect() if r.doc_id in (1, 2, 3)}
    assert len(blank) == 1
    assert toxicity.clean(clashing, model).columns == clashing.columns
    assert toxicity.scored(no_docs, model).count() == 0
    nothing = toxicity.learned(docs, labels.limit(0))
    assert {r.predicted for r in toxicity.scored(docs, nothing).collect()} == {0}
    assert {r.predicted for r in toxicity.scored(docs, toxicity.learned(docs, labels.filter("toxic = 1"))).collect()} == {1}


def test_toxicity_sample_keeps_the_balance(insults, monkeypatch):
    """Where a bound cuts one class of the sample, the base rate stays that of all training labels."""
    table, marks = insults
    base = toxicity.learned(table, marks).bias
    whole = toxicity.sample
    monkeypatch.setattr(toxicity, "sample", lambda labels: whole(labels, clean_rows=60))
    assert toxicity.learned(table, marks).bias == pytest.approx(base, abs=0.35)


def test_label_model_finds_the_better_voters():
    rng = np.random.default_rng(1)
    truth = rng.random(3000) < 0.2
    votes = np.column_stack([rng.random(3000) < np.where(truth, hit, miss) for hit, miss in ((0.8, 0.01), (0.7, 0.02), (0.3, 0.25))])
    votes = np.column_stack((votes, votes[:, 0])).astype(float)  # the first voter twice
    given = np.where(rng.random(3000) < 0.15, ~truth, truth)
    chance = toxicity.label_model(votes, given)
    assert ((chance >= 0.5) == truth).mean() > (given == truth).mean() + 0.05


# --- encoding

def test_bpe_like_the_library(docs, clashing, no_docs, rows, reference):
    texts = {r[0]: r[1] or "" for r in rows}
    for table in (docs, clashing):
        for r in bpe.round_trip(table, RANKS, PATTERN).collect():
            ids = reference.encode_ordinary(texts[r.doc_id])
            assert r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert bpe.round_trip(no_docs, RANKS, PATTERN).count() == 0


def test_bpe_spaces_and_long_pre_tokens(reference):
    own = bpe.Bpe(RANKS, PATTERN)
    rng = random.Random(2)
    letters = " \n\t\0\x1c\x85\xa0　abcABC012'sréß漢🙂.,!-\r"
    for _ in range(60):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(60)] + [" ", "a   b", "  ", "a ", " a", "ab" * 3000 + "z" * 900]
        for text, ids in zip(texts, own.encode_all(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
            assert own.decode(ids) == text.encode()


def test_bpe_finds_the_pre_tokens_of_a_block_at_once(reference):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdeé1'!\n字", k=rng.randint(1, 9))) for _ in range(3_000)]
    texts = [" ".join(words[a : a + 30]) for a in range(0, 3_000, 30)] + [" a b\0 c", " x\0", "  y", ""]
    own, calls, collecting = bpe.Bpe(RANKS, PATTERN), [], []
    find = own.find
    own.find = lambda text: calls.append(text) or collecting.append(gc.isenabled()) or find(text)
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert len(calls) < len(texts) + 100  # one for the chunks that begin with a space, one for each other chunk and text
    assert gc.isenabled() and not any(collecting)
    parts = [" ab", " 1!c", " é's"]
    assert own.pre_tokens(parts) == [find(c) for c in parts]
    own.find = re.compile(r"\w").findall  # a pattern that leaves spaces out
    assert own.pre_tokens(parts) == [own.find(c) for c in parts]


def test_bpe_blocks_that_bring_no_new_chunk(reference, monkeypatch):
    own = bpe.Bpe(RANKS, PATTERN)
    assert list(own.encode_all([])) == []
    assert own.pre_tokens([]) == []
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 8)  # blocks of one or two texts, most of them known, the last one empty
    texts = ["one", "", None, "  ", "x\0 y", "some words", "some words", "some", "words some words", "some words"]
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text or "")


def test_bpe_worker_that_encodes_nothing_keeps_no_cache(monkeypatch):
    monkeypatch.setattr(bpe, "IDLE", 0.2)
    with bpe.working(RANKS, PATTERN) as first:
        first.encode("some words to keep")
    with bpe.working(RANKS, PATTERN) as second:  # the next task comes at once and finds them
        assert second is first and second.chunks.fresh
        time.sleep(0.5)
        assert bpe.loaded(RANKS, PATTERN) is first
    first = second = None
    for _ in range(100):
        if not bpe._loaded:
            break
        time.sleep(0.05)
    assert not bpe._loaded


def test_rank_queue():
    queue, rng, inside = bpe.RankQueue(70_000), random.Random(4), set()
    for _ in range(20_000):
        rank = rng.randrange(70_000)
        if rank in inside:
            queue.remove(rank)
            inside.discard(rank)
        else:
            queue.add(rank)
            inside.add(rank)
        if rng.random() < 0.01:
            assert queue.first() == min(inside, default=-1)
            for r in list(inside):
                if rng.random() < 0.9:
                    queue.remove(r)
                    inside.discard(r)
            assert queue.first() == min(inside, default=-1)


# --- packing

def plain_fit(sizes, length):
    """Best fit decreasing by search through all rows."""
    spaces = []
    for need in sorted((s % length for s in sizes if s % length), reverse=True):
        fits = [i for i, s in enumerate(spaces) if s >= need]
        if fits:
            spaces[min(fits, key=lambda i: spaces[i])] -= need
        else:
            spaces.append(length - need)
    return sum(s // length for s in sizes) + len(spaces), sorted(spaces)


def test_packing_best_fit():
    rng = random.Random(6)
    for length in (1, 2, 7, 64, 100):
        for _ in range(30):
            sizes = [rng.choice([0, 1, length, length + 1, 3 * length, rng.randint(0, 2 * length)]) for _ in range(rng.randint(0, 80))]
            rows = packing.packed(sizes, length)
            pieces = collections.defaultdict(list)
            for row in rows:
                assert 0 < sum(b - a for _, a, b in row) <= length
                for text, a, b in row:
                    pieces[text].append((a, b))
            for text, size in enumerate(sizes):
                at = 0
                for a, b in sorted(pieces[text]):
                    assert a == at
                    at = b
                assert at == size
            free = sorted(length - sum(b - a for _, a, b in row) for row in rows)
            count, spaces = plain_fit(sizes, length)
            assert len(rows) == count and sum(free) == sum(spaces)


def test_packing_is_lossless(spark, docs, no_docs, rows, reference, tmp_path):
    packs = packing.written(docs, str(tmp_path / "packs"), RANKS, PATTERN, 50256, length=256)
    found = collections.defaultdict(list)
    for r in packs.collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == 256 and r.ends[0] == 0 and r.resets == r.ends[:-1] and (ids[r.ends[-1] :] == 50256).all()
        for i, doc in enumerate(r.doc_ids):
            found[doc].append((r.starts[i], ids[r.ends[i] : r.ends[i + 1]].tolist()))
    want = collections.defaultdict(list)
    for r in rows:
        ids = reference.encode_ordinary(r[1] or "") + [50256]
        want[r[0]] += [(a, ids[a : a + 256]) for a in range(0, len(ids), 256)]
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert packing.digests(packing.matrices(no_docs, RANKS, PATTERN, 50256)).count() == 0


# --- licenses

def test_licenses(spark, docs, no_docs):
    texts = {
        1: ("Some text\nReleased under the MIT License.\nmore", ["MIT"]), 2: ("released under the  MIT license", ["MIT"]),
        3: ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]), 4: ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        5: ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]), 6: ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        7: ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
        8: ("This work is licensed under the GNU Lesser General Public License, version 3.", ["LGPL-3.0"]),
        9: ("The license plate of the car was stolen, said the police.", []), 10: ("A driving licence is not a license to kill.", []),
        11: ("Released under the MIT License.\nx\nLicensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0", "MIT"]), 12: (None, []), 13: ("", []),
    }
    table = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scanned(table).collect()}
    assert {k: r.licenses for k, r in got.items()} == {k: v for k, (_, v) in texts.items()}
    assert got[1].n_differences == 0 and got[1].best_license == "MIT" and got[9].n_candidates == 1 and got[12].n_candidates == 0
    assert licenses.scanned(docs).count() == docs.count() and licenses.scanned(no_docs).count() == 0


def test_every_notice_is_found():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for name, (_, notices) in licenses.TEMPLATES.items():
        for notice in notices:
            assert len(scanner.blocks(f"a\n{notice}\nb")) == 1
            assert (name, 0) in [(n, d) for n, _, d in scanner.scan(notice)]


def in_text(scanner, text):
    """The licenses of a text, scanned as the query does."""
    return sorted({name for block in scanner.blocks(text) for name, _, _ in scanner.scan(block)})


def test_notices_in_long_lines():
    """What stands on the same line or in the lines beside it doesn't hide a notice."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    rng = random.Random(21)
    for name, (_, notices) in licenses.TEMPLATES.items():
        for notice in notices:
            for size in (30, 200):
                assert in_text(scanner, f"{sentence(rng, size)} {notice} {sentence(rng, size)}") == [name]
            assert in_text(scanner, notice.upper()) == [name]
    firsts = [notices[0] for _, notices in licenses.TEMPLATES.values()]
    for sep in ("\n", " "):
        assert in_text(scanner, sep.join(firsts)) == sorted(licenses.TEMPLATES)
        for _ in range(40):
            some = rng.sample(sorted(licenses.TEMPLATES), 4)
            assert in_text(scanner, sep.join(licenses.TEMPLATES[n][1][0] for n in some)) == sorted(some)


def test_wrapped_notices(spark):
    """Every notice over several lines, alone and between prose, as comment lines too."""
    rng = random.Random(22)
    texts, want = [], {}
    for name, (_, notices) in licenses.TEMPLATES.items():
        for notice in notices:
            for prose in ("", sentence(rng, 7), sentence(rng, 90)):
                for width, mark in ((72, ""), (72, "# "), (30, " * ")):
                    text = textwrap.fill(f"{prose} {notice} {prose}", width, initial_indent=mark, subsequent_indent=mark, break_on_hyphens=False)
                    want[len(texts)] = [name]
                    texts.append((len(texts), text))
    got = {r.doc_id: r.licenses for r in licenses.scanned(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == want


def test_the_ranking_decides(monkeypatch):
    """The wording that begins both BSD texts fits either license; the one that saves more gets it."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    rng = random.Random(23)
    two, three = (licenses.TEMPLATES[n][1][-1] for n in ("BSD-2-Clause", "BSD-3-Clause"))
    for text, want, other in ((two, "BSD-2-Clause", "BSD-3-Clause"), (three, "BSD-3-Clause", "BSD-2-Clause")):
        for edits in (0, 3, 6):
            changed = text.split(" ")
            for _ in range(edits):
                changed[rng.randrange(8, len(changed))] = sentence(rng, 1)
            found = licenses.words(" ".join(changed))
            numbers = np.array([scanner.number.get(w, -1) for w in found])
            keys, notices = scanner.templates[other]
            assert want == "BSD-3-Clause" or any(list(scanner.stretches(numbers, n, keys)) for n in notices)      # the other fits as well
            assert [x[0] for x in scanner.scan(" ".join(found))] == [want]
    monkeypatch.setattr(scanner, "ranked", lambda block: licenses.Scanner.ranked(scanner, block)[::-1])
    assert [x[0] for x in scanner.scan(" ".join(licenses.words(two)))] == ["BSD-3-Clause"]


def test_compression_rules_out_before_words_are_compared():
    scanner = licenses.Scanner(licenses.TEMPLATES)
    notice = " ".join(licenses.words(licenses.TEMPLATES["MPL-2.0"][1][0]))
    ranked = scanner.ranked(notice)
    saved = len(scanner.plain.compress(notice.encode())) - len(scanner.primed["MPL-2.0"].compress(notice.encode()))
    assert ranked[0] == ("MPL-2.0", saved) and len(ranked) < len(licenses.TEMPLATES) // 2
    assert scanner.ranked("the license plate of the car was stolen") == []


def test_differences_against_plain_code():
    """The least number of words missing or put in, over all stretches, by the plain table."""
    scanner = licenses.Scanner(licenses.TEMPLATES)
    rng = random.Random(24)
    keys, notices = scanner.templates["MPL-2.0"]
    notice = notices[0]
    for _ in range(30):
        found = licenses.words(sentence(rng, 12)) + list(notice) + licenses.words(sentence(rng, 9))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(found))
            if found[at] not in scanner.named and not licenses.is_stem(found[at]):
                found[at : at + 1] = rng.choice([[], ["kalo"], [found[at], "mire"]])
        row = [0] * (len(found) + 1)                # a stretch starts anywhere
        for i, word in enumerate(notice, 1):
            row, old = [i], row
            for j, other in enumerate(found, 1):
                row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] if word == other else 10**6))
        hits = scanner.scan(" ".join(found))
        assert [(n, d) for n, _, d in hits] == ([("MPL-2.0", min(row))] if min(row) <= licenses.MAX_DIFFERENCE * len(notice) else [])


# --- language model

def test_lm_counts_and_base_score(docs, no_docs, rows):
    table = docs
    counts = lm.learned(lm.training_rows(table))
    got = lm.scored(table, counts).collect()
    tokens = [(r[0], [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(r[1] or "")] + [None]) for r in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(t for i, ts in tokens if not held(i) for t in ts)
    n, v = sum(c.values()), len(c)
    want = bag((i if i is not None else 0, held(i), len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 6)) for i, ts in tokens)
    assert bag((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.scored(no_docs, counts).count() == 0
    untrained = lm.learned(no_docs)
    assert (untrained.n, untrained.v) == (0, 0)
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in lm.scored(docs, untrained).collect())


def test_lm_chances_sum_to_one(docs):
    """After any four bytes, the 256 next ones share all of the chance."""
    model = lm.learned(lm.training_rows(docs)).model
    for context in (b"\xff\xff\xff\xff", b"kalo", b" mi ", b"zzzz"):
        runs = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert sum(10.0 ** -lm.costs(model, runs)) == pytest.approx(1, abs=1e-6)


def test_lm_learns(docs, rows):
    """Texts of the corpus cost far less than the same bytes in another order, and a score is the sum of its bytes' costs."""
    counts = lm.learned(lm.training_rows(docs))
    long = max((r[1] for r in rows if r[1]), key=len)
    shuffled = "".join(random.Random(1).sample(long, len(long)))
    cost = lambda t: lm.costs(counts.model, lm.real(*lm.grams([t.encode()]))).sum()
    assert cost(long) < 0.6 * cost(shuffled)
    got = {r.doc_id: r.score for r in lm.scored(docs, counts).collect()}
    for r in rows[:30]:
        assert got[r[0]] == pytest.approx(-cost(r[1] or ""), rel=1e-9)
