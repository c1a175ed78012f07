"""Personal data, cross-tokenizer alignment and spelling variants against plain versions."""
import collections
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import sentence
from vacantia.llm import align, pii, spelling
from vacantia.llm.queries import TOKENIZERS

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def bag(rows):
    return sorted(rows, key=repr)


# --- personal data

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and plain_luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def plain_luhn(digits):
    return sum(sum(divmod(int(c) * (1 + n % 2), 10)) for n, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    return [(kind, m.start(), m.end()) for kind, pattern, right in PLAIN for m in re.finditer(pattern, text or "") if right(m[0])]


PRIVATE = [
    "write to an.na@mail.example.com or +1 (555) 555-0199 now", "x@y x@y.z@w.v a@b.c_d@e.f @ @@ a@.b a.@-.-", "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 0001.2.3.004 1..2.3.4",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "4111111111111111 and 4111111111111112", "+49 (30) 123456 (( +1 2 +12345678 +1234567 +1234567890123456",
    "é🙂 4111111111111111 ü +1 (555) 555-0199", "+1 (555) 555-0199 4111111111111111", "4111111111111111 9.9.9.9", "1" * 5000, "a" * 5000 + "@b.c", "1." * 3000, "٣٤٥ ٣.٤.٥.٦", "", None,
]


@pytest.fixture(scope="module")
def models():
    rng = random.Random(2)
    return pii.learned([sentence(rng, 30) for _ in range(2000)])


def test_base_spans(rows):
    for text in [*PRIVATE, *(r[1] for r in rows)]:
        got = [(kind, *s) for kind, spans in zip(pii.KINDS, pii.base_spans(text)) for s in spans]
        assert got == plain_spans(text), text


def test_base_spans_of_random_signs():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("01256789+.-() @ab_") for _ in range(rng.randint(1, 60)))
        assert [(kind, *s) for kind, spans in zip(pii.KINDS, pii.base_spans(text)) for s in spans] == plain_spans(text), text


def test_found(spark, docs, models, no_docs):
    table = docs.unionByName(spark.createDataFrame([(2000 + n, t, "en", "a", 0) for n, t in enumerate(PRIVATE)], DOCS))
    texts = bag((r.doc_id, r.text) for r in table.collect())
    got = pii.found(table, models).collect()
    assert bag(g.doc_id for g in got) == bag(n for n, _ in texts)
    by_id = collections.defaultdict(list)
    for n, t in texts:
        by_id[n].append(t)
    for g in got:
        digests = {}
        for t in by_id[g.doc_id]:
            spans = plain_spans(t)
            digests[hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()] = (t, spans)
        text, base = digests[g.base_sha256]
        assert [g.n_email, g.n_ip, g.n_card, g.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in g.spans.split(",") if x)]
        assert spans == sorted(spans, key=lambda x: (pii.KINDS.index(x[0]), *x[1:])) and set(base) <= set(spans)
        added = [x for x in spans if x not in set(base)]
        assert len(added) == g.n_added and all(0 <= s < e <= len(text) for _, s, e in spans)
        assert not any(a != b and a[1] < b[2] and b[1] < a[2] for a in added for b in spans)
    assert pii.found(no_docs, models).count() == 0


def test_method_adds_neighbours(models):
    both = "call me at +1 (555) 555-0199 4111111111111111 today"
    (base, added), = pii.all_spans([both], models)
    assert not any(base) and {(pii.KINDS[k], both[s:e]) for k, x in enumerate(added) for s, e in x} == {("phone", "+1 (555) 555-0199"), ("card", "4111111111111111")}


def test_models_on_unseen_spans(models):
    """Held-out precision and recall on planted stretches of another seed."""
    import numpy as np

    rng = random.Random(77)
    rows = collections.defaultdict(list)
    for _, kind, values, true in pii.examples([sentence(rng, 30) for _ in range(800)], seed=123):
        rows[kind].append((values, true))
    for kind, model in enumerate(models):
        x, y = np.array([v for v, _ in rows[kind]], float), np.array([t for _, t in rows[kind]])
        taken = model.probability(x) >= model.threshold
        assert (taken & y).sum() / taken.sum() > 0.93 and (taken & y).sum() / y.sum() > 0.75, pii.KINDS[kind]


def test_clean_numbers_stay(models):
    clean = ["In 1984-1989 about 1,234,567 people", "version 1.2.3 of 2024-01-31 12:30", "pi is 3.14159265358979", "no 4111111111111112 here", "10 20 30 40 50", "we met at home.Then"]
    assert not any(any(a) for _, added in pii.all_spans(clean, models) for a in added)


def test_redacted(spark, models, clashing):
    table = spark.createDataFrame([(1, "a b@c.de f 1.2.3.4", 5), (2, None, 6), (3, "", 7)], "doc_id long, text string, _row int")
    out = pii.redacted(table, models)
    assert out.columns == table.columns
    assert bag(map(tuple, out.collect())) == bag([(1, "a [email] f [ip]", 5), (2, None, 6), (3, "", 7)])
    assert pii.redacted(clashing, models).columns == clashing.columns and pii.found(clashing, models).count() == clashing.count()


def test_without_texts_nothing_is_learned(no_docs):
    assert pii.stretches(no_docs) == []
    (base, added), = pii.all_spans(["a@b.cd 4111111111111111 4111111111111111"], pii.learned([]))
    assert base[0] and not any(added)


def test_sample_is_bounded(docs):
    assert len(pii.stretches(docs, rows=7, chars=20)) == 7 and all(0 < len(s) <= 20 for s in pii.stretches(docs, rows=7, chars=20))


# --- alignment

ODD = ["a", " a", "a  b\n\tc", "<|endoftext|> <s> </s> <unk>", "naïve café ﬁ Ａ　b", "🙂🙃 zwölf", "▁x", "é", "  ", "\n", "x" * 3000, "日本語のテキスト", "\x00a"]


def letters():
    odd = [b for b in range(256) if not (33 <= b < 127 or 161 <= b < 173 or 174 <= b)]
    return {**{chr(b): b for b in range(256) if b not in odd}, **{chr(256 + n): b for n, b in enumerate(odd)}}


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), letters()


def plain_tokens(text, sides):
    a, b, byte = sides
    if not text:
        return [], []
    left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    whole = (" " + text).encode()
    return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else ([], [])


def ranges(tokens):
    out, at = [], 0
    for i, piece in tokens:
        out.append((i, at, at + len(piece)))
        at += len(piece)
    return out


def plain_alignment(texts, sides):
    rows, counts = [], collections.Counter()
    for text in texts:
        a, b = map(ranges, plain_tokens(text, sides))
        links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e] if len(a) < 400 else swept(a, b)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = ";".join(
            ",".join(str(x) for x, s, e in a if lo < e <= hi) + "|" + ",".join(str(y) for y, s, e in b if lo < e <= hi)
            for lo, hi in zip([0, *cuts], cuts)) if len(a) < 400 else None
        rows.append((len(a), len(b), len(cuts), links, groups))
        counts.update(links)
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(na, nb, ng, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
             None if groups is None else hashlib.sha256(groups.encode()).hexdigest() if groups else "") for na, nb, ng, links, groups in rows]


def swept(a, b):
    """The same links for long texts, by one sweep."""
    out, j = [], 0
    for x, s, e in a:
        while b[j][2] <= s:
            j += 1
        k = j
        while k < len(b) and b[k][1] < e:
            out.append((x, b[k][0]))
            k += 1
    return out


@pytest.mark.parametrize(("chars", "lane"), [(1_000_000, 512), (700, 3)])
def test_alignment(spark, docs, sides, chars, lane):
    table = docs.unionByName(spark.createDataFrame([(3000 + n, t, "en", "a", 0) for n, t in enumerate(ODD)], DOCS))
    texts = [(r.doc_id, r.text) for r in table.collect()]
    got = align.digests(align.aligned(table, TOKENIZERS, chars, lane)).collect()
    want = [(n, *row) for (n, _), row in zip(texts, plain_alignment([t for _, t in texts], sides))]
    hidden = {(n, *row[:6]) for n, *row in want if row[6] is None}  # long texts: digest not recomputed
    plain = [(*g[:5], g.n_best, g.count_sum, g.groups_sha256) for g in map(tuple_of, got)]
    assert bag((*p[:7], None if p[:7] in hidden else p[7]) for p in plain) == bag(want)


def tuple_of(row):
    return collections.namedtuple("Out", row.asDict().keys())(**row.asDict())


def test_ids_are_the_librarys(docs, sides, rows):
    a, _ = align._loaded(TOKENIZERS)
    rng = random.Random(5)
    texts = [r[1] for r in rows if r[1]] + ODD + ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x2FF), rng.randint(0x3000, 0x30FF), 10, 32, 0x1F600])) for _ in range(80)) for _ in range(300)]
    for text in texts:
        assert list(a.encode(text)) == sides[0].encode(text, add_special_tokens=False).ids


def test_groups_and_pair_counts(docs, sides, no_docs, clashing):
    texts = {r.doc_id: r.text for r in docs.collect()}
    for g in align.groups(docs, TOKENIZERS).collect():
        a, b = plain_tokens(texts[g.doc_id], sides)
        if [x for x, _ in a] == g.a_ids:  # of a repeated id either text
            ends = [x for _, _, x in ranges(a)], [x for _, _, x in ranges(b)]
            assert [ends[0][x] for x in g.a_ends] == [ends[1][x] for x in g.b_ends] == sorted(set(ends[0]) & set(ends[1]))
    counts = collections.Counter()
    for r in docs.collect():
        counts.update(swept(*map(ranges, plain_tokens(r.text, sides))) if r.text else ())
    assert {(r.a_id, r.b_id): r.n for r in align.pair_counts(align.aligned(docs, TOKENIZERS, 900)).collect()} == counts
    assert align.digests(align.aligned(no_docs, TOKENIZERS)).count() == 0
    assert align.digests(align.aligned(clashing, TOKENIZERS)).count() == clashing.count()


# --- spelling variants

def plain_words(texts):
    counts = collections.Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def near(u, v):
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


def plain_variants(words):
    linked = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and near(v, w)] for w in words}
    form = {}
    for w, others in linked.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    def root(w):
        return w if form[w] is None else root(form[w])
    return [(w, form[w], root(w), n, len(linked[w]), words.get(form[w])) for w, n in words.items()]


def spelled(rng, size):
    """Few letters, many lengths: edits at every place, letters in a row, chains of counts."""
    texts = []
    for n in range(size):
        stem = "".join(rng.choice("aabé") for _ in range(rng.randint(6, 11)))
        k = rng.randrange(len(stem) + 1)
        variants = [stem, stem[:k] + rng.choice("ab") + stem[k:], stem[:k] + stem[k + 1 :], stem[:k] + "ß" + stem[k + 1 :], stem.upper()]
        words = [w for w, times in zip(variants, (120, 11, 2, 1, 1)) for _ in range(rng.choice((1, times)))]
        texts.append((n, " ".join(words) + rng.choice(["", " 9x", "\n", "_"])))
    texts += [(size + n, " ".join(["kalimora"] * 60 + ["kalimorax"] * 5 + ["kalimoraxy"] * (n % 3 == 0))) for n in range(12)]
    return texts


@pytest.mark.parametrize("most", [20_000, 3, 1])
def test_variants(spark, most):
    texts = spelled(random.Random(9), 150) + [(None, "repeated letters repeated letters"), (None, None), (7, ""), (8, "9 9"), (9, "r" * 400 + " " + "r" * 399), (10, "r" * 400 + " " + "r" * 399)]
    table = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    words = spelling.vocabulary(table)
    assert {r.word: r.n for r in words.collect()} == plain_words(texts)
    want = plain_variants(plain_words(texts))
    assert sum(w[1] is not None for w in want) > 50 and any(w[1] not in (None, w[2]) for w in want)
    assert bag(map(tuple, spelling.variants(words, most=most).collect())) == bag(want)


def test_near_pairs_are_found_once(spark):
    texts = spelled(random.Random(10), 60)
    words = plain_words(texts)
    got = [tuple(r) for r in spelling.near_pairs(spelling.vocabulary(spark.createDataFrame(texts, "doc_id long, text string")), most=5).collect()]
    assert len(got) == len({frozenset(r[:2]) for r in got})
    assert {frozenset(r[:2]) for r in got} == {frozenset((u, v)) for u in words for v in words if u < v and near(u, v)}
    assert all((words[a], words[b]) == (n, m) for a, b, n, m in got)


def test_acceptor_is_minimal():
    words = sorted({"tapping", "topping", "tapped", "topped", "stop"})
    made = spelling.Acceptor(words)
    assert {w for w in spelling.shared(made, 0, made, 0)} == set(words)
    reached, ahead = set(), [0]
    while ahead:
        state = ahead.pop()
        if state not in reached:
            reached.add(state)
            ahead += made.arcs[state].values()
    assert len({(made.final[s], *sorted(made.arcs[s].items())) for s in reached}) == len(reached) == 12


def test_no_words(no_docs, clashing):
    assert spelling.variants(spelling.vocabulary(no_docs)).count() == 0
    assert spelling.variants(spelling.vocabulary(clashing)).count() > 0
