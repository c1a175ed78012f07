"""Jaccard join, mixing, URL filters, nearest neighbours and the pipeline against plain versions."""
import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tests.compare import bag, connect
from tests.llm.conftest import near, sentence
from vacantia.llm import ann, jaccard, mixing, urls
from vacantia.llm.queries import ORACLE, QUERIES
from vacantia.llm.words import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


# --- Jaccard join

def plain_links(texts):
    """{doc_id: (set size, component)} by comparing all pairs."""
    sets = {}
    for doc, text in texts.items():
        w = WORD.findall((text or "").translate(LOWER))
        sets[doc] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    head = {d: d for d in sets}

    def root(d):
        while head[d] != d:
            d = head[d]
        return d

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                head[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def linked(table, **options):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(table, **options).collect() if r.doc_id is not None}


def test_jaccard_cases(docs, clashing, no_docs, rows):
    want = plain_links({r[0]: r[1] for r in rows if r[0] is not None})
    assert linked(docs) == want
    assert jaccard.linked(docs).count() == len(rows)
    assert linked(clashing) == want
    assert jaccard.linked(no_docs).count() == 0
    assert [r.component_id for r in jaccard.linked(docs).collect() if r.doc_id is None] == [None]


@pytest.mark.parametrize(("hot", "many"), [(50, 8), (1, 8), (1, 1), (50, 1_000)])
def test_jaccard_families(spark, hot, many):
    """A dense family that no single document holds together, chains of links, shared passages, mixed sizes."""
    rng = random.Random(11)
    texts = {}
    base = sentence(rng, 90)
    for _ in range(120):
        texts[len(texts)] = near(rng, base, rng.randint(0, 9))
    chain = sentence(rng, 80)
    for _ in range(25):
        chain = near(rng, chain, 2)
        texts[len(texts)] = chain
    passage = sentence(rng, 55)
    for _ in range(60):
        texts[len(texts)] = f"{sentence(rng, rng.choice([2, 8, 15, 60]))} {passage} {sentence(rng, rng.choice([1, 3, 30]))}"
    long = sentence(rng, 200)
    for n in (200, 190, 170, 152, 151, 150, 149, 140, 120, 100):
        texts[len(texts)] = " ".join(long.split(" ")[:n])
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert linked(table, hot=hot, many=many) == plain_links(texts)


def test_jaccard_small_blocks(spark, monkeypatch):
    """Families in many blocks: the same links."""
    rng = random.Random(12)
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 3_000)
    base = sentence(rng, 60)
    texts = {n: near(rng, base, rng.randint(1, 8)) for n in range(150)}
    texts |= {200 + n: base for n in range(40)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert linked(table) == plain_links(texts)


def test_jaccard_merges_and_opens_by_hashes_of_several_families_only(spark, monkeypatch):
    rng = random.Random(11)
    base, chain, texts = sentence(rng, 90), sentence(rng, 80), {}
    for _ in range(100):
        texts[len(texts)] = near(rng, base, rng.randint(0, 9))
    for _ in range(25):
        chain = near(rng, chain, 2)
        texts[len(texts)] = chain
    every, met = [], []

    def seen(name, keep):
        step = getattr(jaccard, name)

        def run(posts, *rest):
            out = step(posts, *rest)
            keep.append({(r.token, r.doc_id) for r in (out if keep is every else posts).select("token", "doc_id").collect()})
            if name == "coarser":
                families.update({r.doc_id: r.g for r in rest[0].collect()})
            return out

        monkeypatch.setattr(jaccard, name, run)

    families = {}
    seen("able", every), seen("coarser", met), seen("opened", met)
    got = linked(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4))
    assert got == plain_links(texts)
    held = collections.defaultdict(set)
    for token, doc in every[0]:
        held[token].add(families[doc])
    several = {(token, doc) for token, doc in every[0] if len(held[token]) > 1}
    assert 0 < len(several) < len(every[0])
    assert met == [several, several]


def test_blocks_of_a_batch_are_opened_one_at_a_time():
    rng = np.random.default_rng(8)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary())]))

    def block(first: int) -> list[dict]:
        base = rng.integers(1 << 16, 1 << 62, 8, dtype=np.uint64)
        sets = [np.unique(np.append(base, np.uint64(k << 16) if k % 2 else base[:1])) for k in range(100)]
        return [{"doc_id": first + k, "n": len(t), "tokens": jaccard._packed(t)} for k, t in enumerate(sets)]

    def peak(pairs: int) -> int:
        rows = [pa.array([block(1000 * side + 10_000 * p) for p in range(pairs)], kind) for side in (0, 1)]
        batch = pa.RecordBatch.from_arrays(rows, ["left", "right"])
        same = pa.RecordBatch.from_arrays([rows[0], rows[0]], ["left", "right"])
        tracemalloc.start()
        (apart,), (links,) = jaccard._linked_blocks(iter([batch])), jaccard._linked_blocks(iter([same]))
        high = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert apart.num_rows == 0 and links.num_rows == 99 * pairs  # a spanning tree of each block
        return high

    assert peak(100) < 2 * peak(4)


def test_hashes_rest_on_own_bytes_only():
    """A text hashes alike alone and beside a 5,000-byte word; words that differ past 4,096 bytes stay apart."""
    text, long = b"kalo mi resu one", b"x" * 5_000
    alone = word_hashes(text)[0]
    beside, owner = word_hashes(b"\n".join([text, long, text]))
    assert (beside[owner == 0] == alone).all() and (beside[owner == 2] == alone).all()
    assert beside[owner == 1] == word_hashes(long)[0]
    turned = b"a" + b"x" * 4_095 + b"b", b"b" + b"x" * 4_095 + b"a"
    assert word_hashes(turned[0])[0] != word_hashes(turned[1])[0]


def test_sets_of_copies_beside_long_words():
    rng = random.Random(14)
    base = sentence(rng, 60)
    alone, beside = next(jaccard.shingle_sets([base])), list(jaccard.shingle_sets(["y" * 5_000 + " " + sentence(rng, 20), base]))[1]
    assert jaccard.digest(alone) == jaccard.digest(beside) and (alone == beside).all()


def test_one_of_each(docs, clashing, rows):
    want = plain_links({r[0]: r[1] for r in rows if r[0] is not None})
    keep = sorted({c for _, c in want.values()})
    for table in (docs, clashing):
        out = jaccard.one_of_each(table)
        assert out.columns == table.columns
        ids = [r.doc_id for r in out.collect()]
        assert sorted(i for i in ids if i is not None) == keep and ids.count(None) == 1


def test_components(spark):
    rng = random.Random(13)
    edges = [(n, n + 1) for n in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(45)]
    head = {v: v for e in edges for v in e}
    for _ in range(60):
        for a, b in edges:
            head[a] = head[b] = min(head[a], head[b])
    got = jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.v: r.c for r in got} == head
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- mixing

def test_mixing_targets_and_totals(docs, clashing, no_docs, rows):
    size = lambda t: len(WORD.findall(t or ""))
    sources = collections.Counter()
    for r in rows:
        sources[r[3]] += size(r[1])
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    share, capped = 1.5 * sum(sources.values()), set()
    while True:  # reshare the excess by weight until none is above
        rest = share - sum(2 * sources[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        goal = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if goal[s] > 2 * sources[s] + 1e-9}
        if not over:
            break
        capped |= over
    goal |= {s: 2.0 * sources[s] for s in capped}
    source = {r[0]: r[3] for r in rows}
    for table in (docs, clashing):
        got = mixing.mixture(table).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.source_size == sources[source[r.doc_id]] and r.target == pytest.approx(goal[source[r.doc_id]])
            assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        assert bag(["x"], [(tuple(r),) for r in got]) == bag(["x"], [(tuple(r),) for r in mixing.mixture(table).collect()])
    assert mixing.mixture(no_docs).count() == 0


def test_mixing_comes_near_its_targets(spark):
    rng = random.Random(14)
    rows = [(n, "w " * int(rng.paretovariate(1.2) * 5), "x", rng.choice(["hot"] * 6 + list("abcdef") + [None]), 1) for n in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mixture(table, most=2).toPandas()
    for (_, target), part in out.groupby(["source_size", "target"]):
        assert abs(part.taken.sum() - target) <= 2 * part["size"].max() + 2
    mixed = mixing.mixed(table)
    assert mixed.columns == table.columns
    words = mixed.select(mixing.n_words(mixed["text"]).alias("n")).groupBy().sum("n").first()[0]
    assert words == out.taken.sum()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_against_sql(spark, name):
    con = connect(SF)
    rel = con.execute(ORACLE[name])
    names = [d[0] for d in rel.description]
    got = QUERIES[name](spark, SF)
    assert bag(names, rel.fetchall()) == bag(got.columns, [tuple(r) for r in got.collect()])


# --- URLs

def test_url_cases(spark):
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no-scheme.net/x": ("", "", None, "allow"),
        "http://A.Net/x?y": ("a.net", "/x", "net/", "block"), "http://net/": ("net", "/", "net/", "block"), "http://x.net": ("x.net", "", None, "allow"),
        "http://WWW.Example.net/en/1#t": ("www.example.net", "/en/1", "example.net/en/", "allow"), "http://example.net/en": ("example.net", "/en", "net/", "block"),
        "http://myexample.net/en/": ("myexample.net", "/en/", "net/", "block"), "http://a.example.com/de/": ("a.example.com", "/de/", "example.com/de/", "block"),
        "http://a.example.com/fr/": ("a.example.com", "/fr/", None, "allow"), "http://casino-win.example.com/fr/": ("casino-win.example.com", "/fr/", None, "block"),
        "http://casino-win.example.org/fr/1": ("casino-win.example.org", "/fr/1", "org/fr/", "allow"), "x://y://z.org/fr/": ("y:", "//z.org/fr/", None, "allow"),
        "http://É.ORG/fr/é": ("É.org", "/fr/é", "org/fr/", "allow"), "http://" + "a." * 3000 + "net/" + "p" * 9000: ("a." * 3000 + "net", "/" + "p" * 9000, "net/", "block"),
    }
    table = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filtered(table, urls.RULES).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.filtered(table.limit(0), urls.RULES).count() == 0
    assert {r.rule for r in urls.filtered(table, {}, ()).collect()} == {None}


def test_digest_array_confirms_strings(tmp_path, monkeypatch):
    """With keys that all collide, only equal strings are found."""
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda s: 7)
    listed = {f"h{i}.net/": "block" for i in range(50)}
    (tmp_path / "d").write_bytes(urls.digest_bytes(listed))
    table = urls.DigestArray(str(tmp_path / "d"))
    found = table.find([b"h3.net/", b"other/", b"h49.net/"])
    assert found[1] == -1 and found[0] >= 0 and found[2] >= 0 and found[0] != found[2]


# --- nearest neighbours

def plain_nearest(vectors, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-float((np.array(vectors[q]) * np.array(v)).sum()), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("shard_rows, block_rows", [(16384, 4096), (300, 20), (40, 7)])
def test_nearest_exact_with_ties(spark, shard_rows, block_rows):
    rng = np.random.default_rng(15)
    vectors = {i: (rng.normal(size=8) * rng.choice([0.2, 1, 5])).tolist() for i in range(700)}
    hot = vectors[0]
    vectors |= {i: hot for i in range(700, 1100)}
    vectors |= {2000 + i: rng.normal(size=3).tolist() for i in range(9)}
    bad = [(5000, None), (5001, [0.0] * 8), (5002, [1.0, None] * 4), (5003, [float("nan")] * 8), (5004, [float("inf")] * 8), (None, [1.0] * 8), (5005, [])]
    table = spark.createDataFrame([*vectors.items(), *bad, (3, vectors[3])], "vec_id long, embedding array<double>")
    usable = ann.usable(table)
    queries = [i for i in vectors if i % 20 == 0]
    got = collections.defaultdict(list)
    found = ann.nearest(usable, usable.filter("vec_id % 20 = 0"), 20, 1.0, shard_rows, block_rows).orderBy("query_id", "rank").collect()
    for r in found:
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    assert dict(got) == plain_nearest(vectors, queries, 20)
    assert ann.nearest(usable.limit(0), usable.limit(0), 20).count() == 0


def test_nearest_recall(spark):
    from vacantia.llm.queries import table

    usable = ann.usable(table(spark, SF, "embeddings"))
    vectors = {r.vec_id: list(r.v) for r in usable.collect()}
    want = plain_nearest(vectors, [i for i in vectors if i % 20 == 0], 20)
    got = collections.defaultdict(set)
    for r in QUERIES["op4_nearest"](spark, SF).collect():
        got[r.query_id].add(r.vec_id)
    hits = sum(len(got[q] & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


# --- pipeline

def test_pipeline(spark):
    import corpus_pipeline
    from vacantia.llm.queries import table
    from vacantia.llm.stored import stored

    docs = table(spark, SF, "documents")
    names = docs.columns
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stored(stage(spark, steps[-1], SF)))
    assert [d.columns for d in steps[:-1]] == [names] * 5
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in steps]
    assert set(ids[1]) < set(ids[0]) and set(ids[2]) <= set(ids[1]) and set(ids[4]) <= set(ids[3]) and sorted(ids[4]) == sorted(ids[5])
    # quality: the whole decision, from its parts
    from vacantia.llm import quality
    ratios = quality.as_column(quality.log_ratios(docs, quality.trusted_sample(table(spark, SF, "labels"))))
    assert sorted(ids[1]) == sorted(r.doc_id for r in quality.scored(docs, ratios).filter("kept").collect())
    # near copies: all pairs
    texts = {r.doc_id: r.text for r in steps[2].collect()}
    assert sorted(ids[3]) == sorted({c for _, c in plain_links(texts).values()})
    # mixing: as often as the mix of its input says
    times = {r.doc_id: r.taken // r.size for r in mixing.mixture(steps[3]).collect() if r.size}
    assert collections.Counter(ids[4]) == {d: n for d, n in times.items() if n}
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, steps[5].collect()))
