"""N-gram Jaccard self-join of whole texts, by groups of similar documents and a token-group matrix.

A document's set holds the hashes of its distinct 5-word shingles (of its whole word sequence, if
shorter). Two documents link when the Jaccard similarity of their sets is 0.75 or more. The result
is exact: each link between different sets is found or runs inside one component.

1. Equal sets meet by digest; only the smallest id of each goes on ("head").
2. In hash order, let the prefix of a set of n hold its first n - ceil(0.75 n) + l(n) hashes. Linked
   sets share at least l hashes of their prefixes, l being that of the smaller one (l is 1 + n / 8
   here, 1 + n / 4 in the later steps, where few texts are left). Heads with fewer
   prefix hashes in common with all other texts together are alone, and their texts aren't read again.
   Tasks count hashes of a chunk of documents before anything is shuffled, so a hash in a third of all
   documents makes one row per chunk.
3. Each remaining head is tied to the most central head it shares many hashes with; what hangs together
   so is a family, the group of the method. Families whose documents open each other by hashes that stand in
   many families are merged until nothing merges, so that a dense family is one group.
4. The token-group matrix holds for each family the union of its members' prefix hashes. A document's
   overlap with a union bounds its overlap with every member; families below the bound stay closed.
   Hashes of more than ``HOT`` families open nothing, unless they are so many of a document's prefix that a
   link could rest on them alone; such documents are matched among each other by these hashes as well.
   Sets are compared in blocks, by matrix products: each block of a family with itself and with the heads
   its members are tied to, then the block pairs of families that this leaves in several components, and
   documents with the members of the families they open. A product gives only the links that join
   components, never all pairs.
5. Components over all links, by rounds of smallest neighbour and pointer jumping.

Defined cases: null and blank texts have an empty set, link with nothing and are their own
component; rows with a null doc_id link with nothing and have a null component; rows that repeat a
doc_id are linked as one document and each returned; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.columns import unwrapped, wrapped
from vacantia.llm.stored import stored
from vacantia.llm.words import blocks, gram_hashes, mix, word_hashes

WIDTH = 5
#: Hashes counted together in a task before they are shuffled.
CHUNK = 2_000_000
#: A hash of more groups than this opens no group by itself.
HOT = 50
#: A hash of more groups than this merges groups whose documents share many such hashes.
MANY = 8
#: Hashes in a block of a family, where a document counts as so many more: blocks are bounded in rows too.
BLOCK_TOKENS, ROW_TOKENS = 200_000, 250
#: Rounds in which documents without enough hashes of other groups leave.
PRUNINGS = 2


#: One of so many hashes of a set that a linked pair must share in its prefixes: over all texts, where
#: a short prefix costs least, and over the few texts that are left, where a long one tells more.
FAR, NEAR = 8, 4


def prefix(n: int, part: int) -> int:
    return min(n, n - (3 * n + 3) // 4 + n // part + 1)


def least_shared(n: Column, part: int) -> Column:
    """l of the smallest set that can be linked with one of n."""
    return F.floor(F.ceil(n * 0.75) / part) + 1


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for first, last, block in blocks(texts):
        hashes, owner = word_hashes(block)
        cuts = np.searchsorted(owner, np.arange(last - first + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield np.unique(gram_hashes(hashes[a:b], WIDTH))


def digest(tokens: np.ndarray) -> tuple[int, int]:
    one, two = mix(tokens), mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return int(one.sum().astype(np.int64)), int(two.sum().astype(np.int64))


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(np.int64))


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, ones, twos = [], [], []
        for tokens in shingle_sets(batch.column(1).to_pylist()):
            a, b = digest(tokens)
            sizes.append(len(tokens))
            ones.append(a)
            twos.append(b)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, ones, twos))], ["doc_id", "n", "d1", "d2"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix hashes of chunks of documents: (token, doc_id, k).

    One row per different hash, with the first document and the number k of documents; and for each
    document a row of its own with -k hashes that were met in the chunk before or after.
    """
    ids: list[int] = []
    sets: dict[tuple[int, int, int], tuple[int, np.ndarray]] = {}
    size = 0

    def emptied() -> Iterator[pa.RecordBatch]:
        docs = np.array([d for d, _ in sets.values()], np.int64)
        parts = [t for _, t in sets.values()]
        tokens = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        owner = np.repeat(docs, [len(t) for t in parts])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.empty(0, np.int64)
        k = np.diff(np.append(first, len(tokens)))
        met, times = np.unique(owner[np.repeat(k, k) > 1], return_counts=True)
        out = [np.concatenate((tokens[first], mix(met.view(np.uint64)))), np.concatenate((owner[first], met)), np.concatenate((k, -times))]
        for a in range(0, len(out[0]), 100_000):
            yield pa.RecordBatch.from_arrays([_long(x[a : a + 100_000]) for x in out], ["token", "doc_id", "k"])

    for batch in batches:
        ids = batch.column(0).to_pylist()
        for doc, tokens in zip(ids, shingle_sets(batch.column(1).to_pylist()), strict=True):
            if doc is None or not len(tokens):
                continue
            key = (*digest(tokens), len(tokens))
            if key not in sets:
                sets[key] = (doc, tokens[: prefix(len(tokens), FAR)].copy())
                size += len(sets[key][1])
            elif doc < sets[key][0]:
                sets[key] = (doc, sets[key][1])
            if size >= CHUNK:
                yield from emptied()
                sets.clear()
                size = 0
    yield from emptied()


def _packed(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of each hash, in order."""
    return np.ascontiguousarray((tokens >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view(np.uint64)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, packed = [], []
        for tokens in shingle_sets(batch.column(1).to_pylist()):
            sizes.append(len(tokens))
            packed.append(_packed(tokens))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "n", "tokens"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column(1).to_numpy()
        parts = [_unpacked(t)[: prefix(n, NEAR)] for t, n in zip(batch.column(2).to_pylist(), sizes.tolist(), strict=True)]
        times = [len(p) for p in parts]
        tokens = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [_long(tokens), _long(np.repeat(batch.column(0).to_numpy(), times)), _long(np.repeat(sizes, times))], ["token", "doc_id", "n"])


def components(links: DataFrame) -> DataFrame:
    """(v, c) for each linked id: the smallest id that links lead to."""
    both = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct())
    labels = stored(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("c")))
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "c"), "u").groupBy("v").agg(F.min("c").alias("near"))
        lower = labels.join(near, "v").select("v", F.col("c").alias("was"), F.least("c", "near").alias("c"))
        jumped = lower.join(lower.select(F.col("v").alias("c"), F.col("c").alias("next")), "c")
        labels = stored(jumped.select("v", "next", "was")).select("v", F.col("next").alias("c"), "was")
        if labels.filter("c <> was").isEmpty():
            return labels.select("v", "c")


def able(posts: DataFrame) -> DataFrame:
    """(token, doc_id, n, weight): the shared hashes of documents that share as many as a link needs.

    The weight tells how central a document is: how many documents have its hashes, on average.
    """
    met = posts.withColumn("k", F.count("*").over(Window.partitionBy("token"))).filter("k > 1")
    mine = Window.partitionBy("doc_id")
    counted = met.withColumn("shared", F.count("*").over(mine)).withColumn("weight", F.sum("k").over(mine) / F.col("n"))
    return stored(counted.filter(F.col("shared") >= least_shared(F.col("n"), NEAR)).select("token", "doc_id", "n", "weight"))


def star_pairs(posts: DataFrame) -> DataFrame:
    """Each document with the central one that shares most of its hashes, if these are many.

    Most central is the original of a family of copies. What this step doesn't tie together, the next ones find.
    """
    top = F.first("doc_id").over(Window.partitionBy("token").orderBy(F.desc("weight"), "doc_id"))
    shared = posts.withColumn("a", top).filter("doc_id <> a").groupBy("a", F.col("doc_id").alias("b")).agg(F.count("*").alias("k"), F.first("n").alias("n"))
    best = shared.filter(F.col("k") >= least_shared(F.col("n"), NEAR)).groupBy("b").agg(F.max(F.struct("k", -F.col("a"))).alias("top"))
    return best.select((-F.col("top.col2")).alias("a"), "b")


def block_of(rows: DataFrame) -> DataFrame:
    """``rows`` (f, doc_id, n) with a block number, so that a block of a family has some ``BLOCK_TOKENS``."""
    plan = rows.groupBy("f").agg(F.ceil(F.sum(F.col("n") + ROW_TOKENS) / BLOCK_TOKENS).alias("blocks"))
    return rows.join(plan, "f").select("f", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("block"))


def assigned(sizes: DataFrame, families: DataFrame, stars: DataFrame, asked: DataFrame) -> DataFrame:
    """(kind, f, block, doc_id): which sets have to come together.

    Kind 0: a family's members in blocks, with the central documents they are tied to.
    Kind 1: the documents that ask a family. Kind 2: families of one document that are asked.
    """
    own = block_of(families.select(F.col("v").alias("doc_id"), F.col("c").alias("f")).join(sizes, "doc_id"))
    tied = stars.withColumnRenamed("b", "doc_id").join(own, "doc_id").select("f", F.col("a").alias("doc_id"), "block")
    asks = block_of(asked)
    alone = asked.select("f").distinct().join(families.select(F.col("c").alias("f")).distinct(), "f", "left_anti")
    alone = alone.select("f", F.col("f").alias("doc_id"), F.lit(0).cast("long").alias("block"))
    kinds = [own.unionByName(tied).distinct(), asks, alone]
    named = [df.select(F.lit(k).alias("kind"), "f", F.col("block").cast("long").alias("block"), "doc_id") for k, df in enumerate(kinds)]
    out = named[0].unionByName(named[1]).unionByName(named[2])
    return out.withColumn("id", F.xxhash64("kind", "f", "block"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by matrix products over the hashes that both sides hold."""
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float32)
    places = []
    for sets, flat in ((left, a), (right, b)):
        at = np.searchsorted(both, flat).clip(max=max(0, len(both) - 1))
        keep = np.flatnonzero(both[at] == flat) if len(both) else np.empty(0, np.int64)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[keep]
        order = np.argsort(at[keep], kind="stable")
        places.append((row[order], at[keep][order]))
    for low in range(0, len(both), 4096):
        parts = []
        for (row, at), sets in zip(places, (left, right), strict=True):
            x, y = np.searchsorted(at, (low, low + 4096))
            part = np.zeros((len(sets), 4096), np.float32)
            part[row[x:y], at[x:y] - low] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _block(rows: pa.ListScalar) -> tuple[list[int], np.ndarray, list[np.ndarray]]:
    """Ids, sizes and hashes of one block's sets: a batch holds many blocks, which are opened one at a time."""
    sets = rows.values
    return sets.field("doc_id").to_pylist(), sets.field("n").to_numpy(), [_unpacked(t) for t in sets.field("tokens").to_pylist()]


def _linked_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the documents of two blocks, no more than it takes to join what they join."""
    for batch in batches:
        ones, twos = [], []
        for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
            (ids, n, tokens), (ids2, m, tokens2) = _block(left), _block(right)
            both = overlaps(tokens, tokens2)
            near = 100 * both >= 75 * (n[:, None] + m[None, :] - both)
            head = {d: d for d in (*ids, *ids2)}

            def root(c: int, head: dict[int, int] = head) -> int:
                while head[c] != c:
                    head[c] = c = head[head[c]]
                return c

            for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
                a, b = root(ids[i]), root(ids2[j])
                if a != b:
                    head[a] = b
                    ones.append(ids[i])
                    twos.append(ids2[j])
        yield pa.RecordBatch.from_arrays([pa.array(ones, pa.int64()), pa.array(twos, pa.int64())], ["a", "b"])


def linked_blocks(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (a, b) of the block pairs (id1, id2); left and right: (id, rows)."""
    one = left.select(F.col("id").alias("id1"), F.col("rows").alias("left"))
    two = right.select(F.col("id").alias("id2"), F.col("rows").alias("right"))
    return pairs.join(one, "id1").join(two, "id2").select("left", "right").mapInArrow(_linked_blocks, "a long, b long")


def block_pairs(parts: DataFrame, groups: DataFrame) -> DataFrame:
    """(id1, id2) of each two blocks of a family, but for those that are in one component already."""
    label = groups.select(F.col("v").alias("doc_id"), "c")
    held = parts.join(label, "doc_id", "left").groupBy("f", "id").agg(
        F.min(F.coalesce("c", "doc_id")).alias("low"), F.max(F.coalesce("c", "doc_id")).alias("high"))
    one, two = (held.select("f", *[F.col(c).alias(f"{c}{k}") for c in ("id", "low", "high")]) for k in (1, 2))
    joined = (F.col("low1") == F.col("high1")) & (F.col("low2") == F.col("high2")) & (F.col("low1") == F.col("low2"))
    return one.join(two, "f").filter("id1 < id2").filter(~joined).select("id1", "id2")


def between(posts: DataFrame) -> DataFrame:
    """The ``posts`` (token, doc_id, n, g) of hashes that stand in several families, and in how many (groups)."""
    ranked = posts.withColumn("rank", F.dense_rank().over(Window.partitionBy("token").orderBy("g")))
    return ranked.withColumn("groups", F.max("rank").over(Window.partitionBy("token"))).drop("rank").filter("groups > 1")


def opened(posts: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, f, n): the families but their own that the token-group matrix can't rule out for a document.

    ``posts``: (token, doc_id, n, g), the hashes of each document's prefix and its family. Of two
    families the one with the larger number asks the other.
    """
    for _ in range(PRUNINGS):
        # documents with too few hashes of other families leave; then other hashes have one family only
        shared = between(posts.drop("groups")).withColumn("shared", F.count("*").over(Window.partitionBy("doc_id")))
        posts = stored(shared.filter(F.col("shared") >= least_shared(F.col("n"), NEAR)).drop("shared"))
    # h: hot hashes of the document; a link could rest on as many as l of them
    posts = posts.withColumn("hot", F.col("groups") > hot).drop("groups")
    posts = stored(posts.withColumn("h", F.count_if("hot").over(Window.partitionBy("doc_id"))))
    cool, warm = posts.filter("NOT hot"), posts.filter("hot").filter(F.col("h") >= least_shared(F.col("n"), NEAR))

    def by(p: DataFrame, slack: Column) -> DataFrame:
        union = p.select("token", F.col("g").alias("f")).distinct()
        bound = p.join(union, "token").filter("f < g").groupBy("doc_id", "f").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("h").alias("h"))
        return bound.filter(F.col("k") + slack >= least_shared(F.col("n"), NEAR)).select("doc_id", "f", "n")

    return by(cool, F.col("h")).union(by(warm, F.col("n"))).distinct()


def coarser(posts: DataFrame, family: DataFrame, many: int) -> DataFrame:
    """(doc_id, g) with families merged whose documents open each other by frequent hashes; both from it and ``posts``.

    The hashes of a dense family of near copies stand in thousands of small families. Of each hash in more
    than ``many``, every document meets only the largest family that holds it, so rows grow with the
    posts of these hashes; a document that the family's union can't be ruled out for merges its own family with the
    one it shares most with. This repeats until nothing merges. Any grouping gives the same links.
    """
    held = posts.join(family, "doc_id").select("token", "g").distinct().groupBy("token").count().filter(F.col("count") > many)
    posts = stored(posts.join(held.select("token"), "token").select("token", "doc_id", "n"))
    while True:
        sizes = family.groupBy("g").agg(F.count("*").alias("size"))
        mine = posts.join(family, "doc_id")
        top = mine.select("token", "g").distinct().join(sizes, "g").groupBy("token").agg(
            F.count("*").alias("groups"), F.max(F.struct("size", (-F.col("g")).alias("less"))).alias("top"))
        frequent = top.filter(F.col("groups") > many).select("token", (-F.col("top.less")).alias("f"))
        met = mine.join(frequent, "token").filter("g <> f").groupBy("doc_id", "g", "f").agg(F.count("*").alias("k"), F.first("n").alias("n"))
        able_ = met.filter(F.col("k") >= least_shared(F.col("n"), NEAR))
        ties = stored(able_.groupBy("g").agg(F.max(F.struct("k", (-F.col("f")).alias("less"))).alias("best")).select(
            F.col("g").alias("a"), (-F.col("best.less")).alias("b")))
        if ties.isEmpty():
            return family
        merged = components(ties).select(F.col("v").alias("g"), "c")
        family = stored(family.join(merged, "g", "left").select("doc_id", F.coalesce("c", "g").alias("g")))


def linked(docs: DataFrame, hot: int = HOT, many: int = MANY) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sized = stored(texts.mapInArrow(_sized, "doc_id long, n long, d1 long, d2 long"))
    known = sized.filter("n > 0 AND doc_id IS NOT NULL")
    heads = known.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("head"))
    equal = stored(known.join(heads, ["n", "d1", "d2"]).select(F.col("head").alias("a"), F.col("doc_id").alias("b"), "n"))

    counted = texts.mapInArrow(_counted, "token long, doc_id long, k long")
    met = counted.withColumn("tasks", F.count("*").over(Window.partitionBy("token")))
    weight = F.when(F.col("k") < 0, -F.col("k")).when((F.col("k") == 1) & (F.col("tasks") > 1), F.lit(1))
    shared = met.select("doc_id", weight.alias("w")).filter("w > 0").groupBy("doc_id").agg(F.sum("w").alias("w"))
    head = equal.filter("a = b").select(F.col("a").alias("doc_id"), "n")
    going = shared.join(head, "doc_id").filter(F.col("w") >= least_shared(F.col("n"), FAR)).select("doc_id").distinct()
    sets = stored(texts.join(stored(going), "doc_id").dropDuplicates(["doc_id"]).mapInArrow(_whole, "doc_id long, n long, tokens binary"))
    posts = able(sets.mapInArrow(_prefixes, "token long, doc_id long, n long"))
    stars = stored(star_pairs(posts))
    families = components(stars)
    family = families.select(F.col("v").alias("doc_id"), F.col("c").alias("g"))
    family = stored(posts.select("doc_id").distinct().join(family, "doc_id", "left").select("doc_id", F.coalesce("g", "doc_id").alias("g")))
    # a hash of one family only merges and opens nothing, and merging never brings it a second one
    several = stored(between(posts.drop("weight").join(family, "doc_id")).select("token", "doc_id", "n"))
    family = coarser(several, family, many)
    tied = family.groupBy("g").agg(F.count("*").alias("docs")).filter("docs > 1").select("g")
    families = stored(family.join(tied, "g").select(F.col("doc_id").alias("v"), F.col("g").alias("c")))
    asked = stored(opened(several.join(family, "doc_id"), hot))

    parts = stored(assigned(sets.select("doc_id", "n"), families, stars, asked))
    row = F.struct("doc_id", "n", "tokens").alias("row")
    blocks = stored(parts.select("kind", "f", "id", "doc_id").join(sets, "doc_id").select("kind", "f", "id", row).groupBy("kind", "f", "id").agg(
        F.collect_list("row").alias("rows")))
    own = blocks.filter("kind = 0")
    near = stored(own.select(F.col("rows").alias("left"), F.col("rows").alias("right")).mapInArrow(_linked_blocks, "a long, b long"))
    pairs = block_pairs(parts.filter("kind = 0"), components(near))
    inside = stored(linked_blocks(own, own, pairs))
    asking = parts.filter("kind = 1").select("f", F.col("id").alias("id1")).distinct()
    across = stored(linked_blocks(blocks, blocks, asking.join(parts.filter("kind <> 1").select("f", F.col("id").alias("id2")).distinct(), "f").select("id1", "id2")))

    joined = components(equal.filter("a <> b").select("a", "b").union(near).union(inside).union(across))
    return sized.join(joined, F.col("doc_id") == F.col("v"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component, once each; columns unchanged."""
    keep = linked(docs).filter("doc_id = component_id OR doc_id IS NULL").select("doc_id").distinct()
    rows = wrapped(docs, F.col("doc_id").cast("long").alias("doc_id"))
    first = rows.join(keep, "doc_id").withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id"))).filter("n = 1")
    return unwrapped(first.select("_row").union(rows.filter("doc_id IS NULL").select("_row")), docs.columns)
