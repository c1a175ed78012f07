"""Personal data in whole texts: strict base patterns, and spans that boosted trees pick among candidates.

Base spans follow fixed rules (e-mail addresses, IPv4 addresses, card numbers, phone numbers). What these
rules miss, as when two numbers stand side by side, or an address is spelled out, is left to the method:
generators of high recall propose overlapping spans of each kind; features of their format and surroundings
go through gradient boosted trees, one model per kind; a span at or above its model's calibrated threshold
is taken, the likeliest first, unless it overlaps a base span or one taken before. Base spans always stay.

The trees learn from planted spans of every kind in many spellings, and from look-alikes (numbers that fail
a checksum, dates, versions, amounts), set into stretches of the corpus: ``SAMPLE_ROWS`` rows at most, those
of the smallest hash, ``SAMPLE_CHARS`` characters of each. All else goes through whole texts. Every fourth
planted stretch is held back to calibrate.

Defined cases: null and empty texts have no spans; a null doc_id is returned as it is; repeated rows give
the same spans each; an empty table gives an empty result; places are code points, ends exclusive; long
texts are read in time linear in their length; further columns are not looked at (``redacted`` keeps them).
"""
from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.boosting import Boosted, boosted, calibrate
from vacantia.llm.columns import unwrapped, wrapped

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS = 3_000
SAMPLE_CHARS = 200
PRECISION = 0.98
RESULT = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")

Span = tuple[int, int]


# --- base rules

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a quad can't begin within a run of digits: from the run's start it would have been found or missed before
_QUAD = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _local_start(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] in _LOCAL:
        at -= 1
    return at


def emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = _local_start(text, at, done)
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((start, host.end()))
        done = host.end() if host else at + 1
        at = text.find("@", done)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        value = int(c) << (n & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def octets(text: str) -> bool:
    return all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in text.split("."))


def ips(text: str) -> list[Span]:
    return [m.span() for m in _QUAD.finditer(text) if octets(m[0])]


def cards(text: str) -> list[Span]:
    return [m.span() for m in _DIGITS.finditer(text) if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PLUS.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]


def base_spans(text: str | None) -> list[list[Span]]:
    """Spans of each kind, in the order of ``KINDS``."""
    return [rule(text) if text else [] for rule in (emails, ips, cards, phones)]


# --- candidates

_GAP = r"\x20.()/ ‐-―-"
_ZONE = re.compile(rf"[+(]?[0-9][0-9{_GAP}+]*")
_GROUP = re.compile(r"[0-9]+")
_AT = re.compile(r"\x20?[(\[{<]\x20?at\x20?[)\]}>]\x20?|\x20?＠\x20?|\x20@\x20?|@\x20|@|\x20at\x20", re.I)
_DOT = r"(?:\.|\x20?[(\[{<]\x20?dot\x20?[)\]}>]\x20?|\x20dot\x20)"
_SPELLED = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}", re.I)
MOST_GROUPS = 8  # no spelling of a number has more

Candidate = tuple[int, int, int, tuple[int, int, int, int]]  # kind, start, end, surroundings


def candidates(text: str) -> Iterator[Candidate]:
    """Overlapping spans that may be of a kind; surroundings: groups of digits before and behind in the
    same run, and the form of at and of dot."""
    done = 0
    for m in _AT.finditer(text):
        start = _local_start(text, m.start(), max(done, m.start() - 64))
        host = _SPELLED.match(text, m.end())
        if start < m.start() and host:
            sign = m[0].strip().lower()
            form = 0 if sign == "@" else 1 if sign == "＠" else 2 if len(sign) > 2 else 3
            dots = host[0].lower()
            yield 0, start, host.end(), (0, 0, form + 4 * (m[0] != m[0].strip()), ("dot" in dots) + 2 * (" " in dots))
            done = m.end()
    for zone in _ZONE.finditer(text):
        groups = [(zone.start() + g.start(), zone.start() + g.end()) for g in _GROUP.finditer(zone[0])]
        for i, (first, _) in enumerate(groups):
            count = 0
            for j in range(i, min(i + MOST_GROUPS, len(groups))):
                count += groups[j][1] - groups[j][0]
                if count > 19:
                    break
                around = (i, len(groups) - 1 - j, 0, 0)
                end = groups[j][1]
                if j == i + 3 and text[first:end].count(".") == 3:
                    yield 1, first, end, around
                if count >= 13:
                    yield 2, first, end, around
                if 7 <= count <= 15:
                    start = first
                    while start > zone.start() and text[start - 1] in "(+":
                        start -= 1
                    yield 3, start, end, around


# --- features

_CUES = [re.compile(p, re.I) for p in (
    r"mail|contact|write to|reach", r"\bip\b|host|server|address|from", r"card|visa|master|credit|pay|amex",
    r"phone|\btel|call|mobile|fax|whatsapp|dial", r"order|isbn|version|\bid\b|invoice|\bref|serial|account|\bv\.?$")]


def _side(text: str, at: int) -> int:
    if not 0 <= at < len(text):
        return 0
    c = text[at]
    return 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:!?)]}\"'" else 5


def features(text: str, found: Candidate) -> list[float]:
    kind, start, end, around = found
    span = text[start:end]
    before = text[max(0, start - 40) : start]
    cues = [float(p.search(before) is not None) for p in _CUES]
    common = [end - start, _side(text, start - 1), _side(text, end), *around, *cues]
    if kind == 0:
        host = re.split(_DOT, span[-200:], flags=re.I)
        last = host[-1]
        return [*common, len(host), len(last), last.isalpha(), span.count(" "), sum(c.isdigit() for c in span), span.count("-"),
                _local_start(span, len(span), 0), span[:1].isalnum(), max(map(len, host))]
    sizes = [len(x) for x in _GROUP.findall(span)]
    digits = only_digits(span)
    first = [*sizes, 0, 0, 0, 0, 0][:5]
    gaps = [span.count(" "), span.count("-"), span.count("."), span.count("("), span.count(")"), span.count("/"), span.count("+")]
    values = [int(x[-4:]) for x in _GROUP.findall(span)]
    return [*common, len(digits), len(sizes), *first, sizes[-1], max(sizes), min(sizes), *gaps, luhn(digits), int(digits[0]), int(digits[:2]),
            len(set(digits)), max(values), sum(x > 255 for x in values), sum(len(x) > 1 and x[0] == "0" for x in _GROUP.findall(span)),
            len([c for c in span if ord(c) > 127]), len({c for c in span if not c.isdigit()})]


# --- planted spans to learn from

def _number(rng: random.Random, size: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(size))


def _card(rng: random.Random, valid: bool = True) -> str:
    head, size = rng.choice([("4", 16), ("5" + rng.choice("12345"), 16), ("6011", 16), ("35", 16), ("", 16), ("37", 15), ("62", 19)])
    digits = head + _number(rng, size - 1 - len(head))
    check = next(c for c in "0123456789" if luhn(digits + c))
    digits += check if valid else rng.choice([c for c in "0123456789" if c != check])
    gap = rng.choice(["", "", "", " ", "-", ".", " "])
    if not gap:
        return digits
    cuts = [4, 10] if size == 15 else range(4, size, 4)
    return gap.join(digits[a:b] for a, b in zip([0, *cuts], [*cuts, size]))


def _phone(rng: random.Random) -> str:
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    country = rng.choice("123456789") + _number(rng, rng.randint(0, 1))
    return rng.choice([
        f"+{country} ({a}) {b}-{c}", f"+{country} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{country} {a} {b} {c}",
        f"+{country}{a}{b}{c}", f"00{country} {a} {b} {c}", f"+{country}-{a}-{b}-{c}", f"+{country} {a}{b} {c}", f"+{country} {a} {b} {c}"])


def _ip(rng: random.Random) -> str:
    return ".".join(str(rng.randint(0, 255)) for _ in range(4))


def _email(rng: random.Random) -> str:
    word = lambda: "".join(rng.choice("aeioubcdfghklmnprst") for _ in range(rng.randint(2, 9)))
    local = rng.choice([word(), f"{word()}.{word()}", f"{word()}.{_number(rng, 2)}", f"{word()}{_number(rng, 2)}", f"{word()}_{word()}"])
    host = [rng.choice([word(), f"{word()}-{word()}", f"{word()}{_number(rng, 1)}"]) for _ in range(rng.randint(1, 2))]
    host.append(rng.choice(["com", "org", "net", "de", "io", "edu", "info"]))
    at, dot = rng.choice([("@", "."), ("@", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" @ ", "."), ("＠", "."), (" (at) ", ".")])
    return local + at + dot.join(host)


def _no_email(rng: random.Random) -> str:
    word = lambda: "".join(rng.choice("aeioubcdfghklmnprst") for _ in range(rng.randint(2, 9)))
    return rng.choice([
        f"{word()} at {word()}.{word().title()}", f"{word()} at {word()}.py", f"{word()} at {_number(rng, 1)}.{_number(rng, 2)}", f"{word()} at {word()} dot {word()}ing",
        f"{word()} @ {_number(rng, 2)}.{_number(rng, 1)}", f"{word()} (at) {word()}.{word().title()}", f"{word()} @ {word()}.{word().title()}", f"{word()} at {word()}.{word()}.{word()}()"])


def _alike(rng: random.Random) -> str:
    n = lambda size: _number(rng, size)
    return rng.choice([
        lambda: _card(rng, False), lambda: _card(rng, False), lambda: n(rng.randint(7, 12)), lambda: n(rng.randint(13, 30)),
        lambda: f"{rng.randint(1900, 2040)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2040)}",
        lambda: f"{rng.randint(1900, 2040)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02} {rng.randint(10, 23)}", lambda: f"{n(3)}.{n(3)}.{n(3)}", lambda: f"{rng.randint(0, 9)}.{n(8)}",
        lambda: f"{rng.randint(256, 999)}.{rng.randint(0, 255)}.{rng.randint(256, 999)}.{rng.randint(0, 255)}", lambda: f"{n(1)}.{n(1)}.{n(2)}.{n(4)}",
        lambda: f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", lambda: f"{rng.randint(1900, 2040)}-{rng.randint(1900, 2040)}", lambda: f"{n(4)} {n(4)}", lambda: f"{n(2)} {n(3)} {n(4)} {n(2)}",
        lambda: f"{n(1)}.{n(2)}.{n(1)}.{n(1)}.{n(2)}", lambda: f"({n(4)}) {n(3)}", *[lambda: _no_email(rng)] * 5, lambda: f"{n(2)}/{n(2)}/{n(4)} {n(2)}"])()


_PLANTS = (_email, _ip, _card, _phone)


def examples(stretches: list[str], seed: int = 11) -> Iterator[tuple[int, int, list[float], bool]]:
    """(number of the stretch, kind, features, whether it is a span) of candidates in planted stretches."""
    rng = random.Random(seed)
    for number, stretch in enumerate(stretches):
        cut = rng.randint(0, len(stretch))
        while 0 < cut < len(stretch) and not stretch[cut].isspace():
            cut -= 1
        text, true = stretch[:cut], set()
        text += "" if not text or text[-1].isspace() else " "
        for _ in range(rng.choice([1, 1, 1, 2, 2, 3])):
            if rng.random() < 0.4:
                text += _alike(rng)
            else:
                kind = rng.randrange(len(KINDS))
                start = len(text)
                text += _PLANTS[kind](rng)
                true.add((kind, start, len(text)))
            text += rng.choice([" ", " ", " ", ", ", ". ", "\n", "; "])
        text += stretch[cut:].lstrip()
        true |= {(kind, *span) for kind, spans in enumerate(base_spans(stretch[:cut])) for span in spans}
        for found in candidates(text):
            # what lies behind the planted part is unknown, unless the base rules know it
            yield number, found[0], features(text, found), found[:3] in true


def learned(stretches: list[str], precision: float = PRECISION, seed: int = 11) -> list[Boosted]:
    """A calibrated model per kind. Without stretches nothing can be learned and no model takes a span."""
    rows: list[list[tuple[int, list[float], bool]]] = [[] for _ in KINDS]
    for number, kind, values, is_span in examples(stretches, seed):
        rows[kind].append((number, values, is_span))
    models = []
    for kind in rows:
        held = np.array([n % 4 == 0 for n, _, _ in kind], bool)
        x, y = np.array([v for _, v, _ in kind], float), np.array([t for _, _, t in kind], float)
        if not len(kind) or any(not 0 < y[side].sum() < side.sum() for side in (held, ~held)):
            models.append(Boosted())
            continue
        models.append(boosted(x[~held], y[~held]))
        calibrate(models[-1], x[held], y[held], precision)
    return models


def stretches(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[str]:
    """One stretch of each of the rows of smallest hash; at most ``rows`` times ``chars`` characters."""
    order = F.xxhash64("doc_id", "text")
    texts = docs.filter(F.length("text") > 0)
    place = F.pmod(order, F.greatest(F.length("text") - chars, F.lit(1))).cast("int") + 1
    picked = texts.select(order.alias("o"), F.substr("text", place, F.lit(chars)).alias("s"))
    # twice as many as are wanted lie below this hash, so that no task hands on its own smallest rows
    share = min(1.0, 2 * rows / max(1, texts.count()))
    for below in (int((share - 0.5) * 2**64), 2**63):
        found = [r.s for r in picked.filter(F.col("o") < min(below, 2**63 - 1)).orderBy("o", "s").limit(rows).collect()]
        if len(found) == rows:
            break
    # a small corpus lends its stretches several times over
    return found * -(-rows // len(found)) if found else []


# --- all spans

def all_spans(texts: list[str | None], models: list[Boosted]) -> Iterator[tuple[list[list[Span]], list[list[Span]]]]:
    """Base spans and added spans of each text, each by kind."""
    bases = [base_spans(t) for t in texts]
    open_: list[list[tuple[int, Candidate]]] = [[] for _ in KINDS]
    for n, (text, base) in enumerate(zip(texts, bases)):
        if not text:
            continue
        taken = sorted(s for spans in base for s in spans)
        at = 0
        for found in sorted(candidates(text), key=lambda c: c[1]):
            while at < len(taken) and taken[at][1] <= found[1]:
                at += 1
            if at == len(taken) or taken[at][0] >= found[2]:
                open_[found[0]].append((n, found))
    likely: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
    for kind, (model, rows) in enumerate(zip(models, open_)):
        for first in range(0, len(rows), 20_000):
            part = rows[first : first + 20_000]
            p = model.probability(np.array([features(texts[n], found) for n, found in part], float)) if model.trees else np.zeros(len(part))
            for k in np.flatnonzero(p >= model.threshold):
                n, (_, start, end, _) = part[k]
                likely[n].append((-float(p[k]), start, -end, kind))
    for n, base in enumerate(bases):
        added: list[list[Span]] = [[] for _ in KINDS]
        starts: list[int] = []
        ends: list[int] = []
        for _, start, end, kind in sorted(likely[n]):  # none of them overlaps a base span
            at = bisect_right(starts, start)
            if (not at or ends[at - 1] <= start) and (at == len(starts) or starts[at] >= -end):
                starts.insert(at, start)
                ends.insert(at, -end)
                added[kind].append((start, -end))
        yield base, added


def written(spans: list[list[Span]]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for kind, found in zip(KINDS, spans) for s, e in sorted(found))


def _finder(models: list[Boosted]):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, added in all_spans(batch.column(1).to_pylist(), models):
                rows.append((
                    *map(len, base), hashlib.sha256(written(base).encode()).hexdigest(),
                    written([b + a for b, a in zip(base, added)]), sum(map(len, added))))
            columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(7)]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[x.split()[0] for x in RESULT.split(", ")])

    return find


def found(docs: DataFrame, models: list[Boosted]) -> DataFrame:
    """Base counts and digest, and all spans, of every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_finder(models), RESULT)


def redacted(docs: DataFrame, models: list[Boosted]) -> DataFrame:
    """``docs`` with every span of a text replaced by its kind in square brackets; all columns stay."""
    at = docs.columns.index("text")

    def redact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            out = []
            for text, (base, added) in zip(texts, all_spans(texts, models)):
                marks = sorted((s, e, kind) for kind, b, a in zip(KINDS, base, added) for s, e in b + a)
                parts, done = [], 0
                for s, e, kind in marks:
                    if e > done:
                        parts += [text[done : max(s, done)], f"[{kind}]"]
                        done = e
                out.append(text if text is None else "".join(parts) + text[done:])
            row = batch.column(1)
            fields = [pa.array(out, pa.string()) if n == at else row.field(n) for n in range(row.type.num_fields)]
            yield pa.record_batch([pa.StructArray.from_arrays(fields, fields=[row.type.field(n) for n in range(len(fields))])], names=["_row"])

    held = wrapped(docs, F.col("text").alias("_text")).select("_text", "_row")
    return unwrapped(held.mapInArrow(redact, held.select("_row").schema), docs.columns)
