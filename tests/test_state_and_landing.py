"""Narrow-first de-duplication, bucketed state, landed files and streams, against plain code and file listings."""
import glob
import gzip
import io
import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tests.test_behaviour import CAST, PARAMS, frame, posting, run_args
from vacantia import params as P
from vacantia.operators import dedup, upsert
from vacantia.params import Params, params_from_config
from vacantia.plans import catalog, daily
from vacantia.schema import POSTINGS, REFRESHED, SALARY_CACHE
from vacantia.sources import feeds, payload_files, registry, state as S
from vacantia.streaming import ingest

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


# ---- narrow-first collapse ---------------------------------------------------------------

@pytest.mark.parametrize("name", ["batch_collapse", "distinct_url_first", "distinct_url_last", "score_postings"])
def test_no_sort_aggregation(spark, name):
    assert "SortAggregate" not in plan(catalog.QUERIES[name](spark, SF))


def sightings_of(rng, n):
    """A third of all rows are of one key."""
    rows = []
    for i in rng.sample(range(10 * n), n):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(n // 5)}"
        rows.append((key, rng.choice([None, 1, 2, 3]), i, f"u{i}", f"s{i % 3}", f"t{i}", "c", None, "x" * (i % 50), None, None, None, None, None))
    return rows


@pytest.mark.parametrize("order", [["day", "ord"], ["ord"], ["name", "ord"], ["at", "ord"]])
def test_collapse_against_plain_code(spark, order):
    rows = sightings_of(random.Random(4), 600)
    df = spark.createDataFrame(rows, "url_hash string, day int, ord long, url string, source string, title string, company string, location string, "
                               "description string, posted_date string, visa_sponsorship boolean, remote_type string, employment_type string, salary_text string")
    df = df.withColumn("name", F.format_string("f%05d", F.col("ord") % 7)).withColumn(
        "at", F.expr("timestamp_ntz'1969-12-31 23:59:58.5' + make_dt_interval(0, 0, 0, cast(ord % 5 as decimal(18,6)) / 2)")).repartition(5)
    place = {"day": lambda r: (r[1] is not None, r[1] or 0), "ord": lambda r: r[2], "name": lambda r: r[2] % 7, "at": lambda r: r[2] % 5}
    at = lambda r: tuple(place[name](r) for name in order)
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    want = {k: (min(g, key=at)[3:5], max(g, key=at)[5], len(g)) for k, g in groups.items()}
    got = dedup.collapse_batch(df, order).collect()
    assert {r.url_hash: ((r.url, r.source), r.title, r.sightings) for r in got} == want and len(got) == len(want)
    first = {r.url_hash: r.url for r in dedup.distinct_first(df, ["url_hash"], order).collect()}
    last = {r.url_hash: r.title for r in dedup.distinct_last(df, "url_hash", order).collect()}
    assert first == {k: v[0][0] for k, v in want.items()} and last == {k: v[1] for k, v in want.items()}


def test_null_keys_are_one_group(spark):
    df = spark.createDataFrame([(None, 2, "b"), (None, 1, "a"), ("", 4, "d"), ("x", 3, "c")], "url string, ord long, v string")
    assert sorted((r.url or "-", r.v) for r in dedup.distinct_first(df, ["url"], ["ord"]).collect()) == [("-", "a"), ("-", "d"), ("x", "c")]
    assert [(r.url, r.v, r.first_pos) for r in dedup.distinct_last(df, "url", ["ord"]).collect()] == [("x", "c", 3)]


def test_packed_positions_keep_the_order(spark):
    rng = random.Random(8)
    edges = [None, -(2**63), 2**63 - 1, 0, -1, 1]
    rows = [(rng.choice([None, -(2**31), 2**31 - 1, 0, 5]), rng.choice(edges)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a int, b long")
    got = df.select("a", "b", dedup.packed_position(df, ["a", "b"]).alias("p")).collect()
    value = lambda x: (x is not None, x or 0)
    ordered = sorted(got, key=lambda r: r.p)
    assert [(value(r.a), value(r.b)) for r in ordered] == sorted((value(a), value(b)) for a, b in rows)
    assert len({r.p for r in got}) == len(set(rows))


# ---- buckets and manifests ------------------------------------------------------------------


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    root, now = str(tmp_path / "state"), daily.ts("2026-01-01 00:00:00")
    new = S.Generation(spark, root)
    daily.upsert_batch(new, frame(spark, *[posting(i) for i in range(40)]), ["ord"], now)
    assert new.commit("2026-01-01 00:00:00") == 1
    before = S.snapshot(spark, root)
    assert len(before.folders["postings"]) > 8 and not os.path.exists(f"{root}/_staging/{new._name}")
    stamps = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/tables/**/*.parquet", recursive=True)}

    new = S.Generation(spark, root)
    seen = daily.upsert_batch(new, frame(spark, posting(7, title="New title"), posting(7, ord=99, title="Newer title")), ["ord"], now).collect()
    new.commit("2026-01-02 00:00:00")
    after = S.snapshot(spark, root)
    changed = [b for b in after.folders["postings"] if after.folders["postings"][b] != before.folders["postings"][b]]
    row, = S.read_state(spark, root)["postings"].filter("title = 'Newer title'").collect()
    assert changed == [row.url_hash[0]] and [(r.is_new, r.sightings) for r in seen] == [(False, 2)]
    assert after.folders["status"] == before.folders["status"] and after.folders["matches"] == before.folders["matches"]
    assert all(os.stat(f).st_mtime_ns == t for f, t in stamps.items())          # nothing overwritten
    assert S.read_state(spark, root)["postings"].count() == 40 and after.number == 2


def test_the_second_writer_fails(spark, tmp_path):
    root = str(tmp_path / "state")
    one, two = S.Generation(spark, root), S.Generation(spark, root)
    for k, new in enumerate((one, two)):
        new.write("status", spark.createDataFrame([("ab", f"s{k}")], S.STATUS))
    one.commit("2026-01-01 00:00:00")
    with pytest.raises(S.StateConflict):
        two.commit("2026-01-01 00:00:00")
    assert [r.status for r in S.snapshot(spark, root).read("status").collect()] == ["s0"]


def test_a_cut_off_manifest_does_not_count(spark, tmp_path):
    root = str(tmp_path / "state")
    S.write_state({"salary_lookup_cache": spark.createDataFrame([], SALARY_CACHE)}, root, "2026-01-01 00:00:00")
    (tmp_path / "state" / "_commits" / "000000002.json").write_text('{"generation": 2, "fold')
    assert S.current_generation(spark, root) == 1


def test_merge_replaces_by_key_in_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path / "state")
    rng = random.Random(2)
    keys = [f"{rng.getrandbits(64):016x}" for _ in range(200)]
    new = S.Generation(spark, root, digits=2)
    new.write("status", spark.createDataFrame([(k, "new") for k in keys], S.STATUS))
    new.commit("2026-01-01 00:00:00")
    changes = spark.createDataFrame([(keys[0], "applied"), (keys[0][:2] + "z" * 14, "new")], S.STATUS)
    new = S.Generation(spark, root)
    assert new.digits == 2 and new.merge("status", changes) == [keys[0][:2]]
    assert {r.url_hash: r.status for r in new.read("status").collect()} == {k: "new" for k in keys} | {r.url_hash: r.status for r in changes.collect()}
    assert new.merge("status", changes.limit(0)) == []
    new.write("status", spark.createDataFrame([], S.STATUS), [keys[0][:2]])     # a bucket can become empty
    assert keys[0][:2] not in new.folders["status"]


def test_expired_generations_and_leftovers_go(spark, tmp_path):
    root = str(tmp_path / "state")
    status = lambda v: spark.createDataFrame([("ab", v)], S.STATUS)
    for n in range(4):
        new = S.Generation(spark, root)
        new.write("status", status(f"s{n}"))
        new.commit("2026-01-01 00:00:00")
    dead = S.Generation(spark, root)
    dead.number, dead._name = 4, "000000004-dead"                       # a writer that lost
    dead.write("status", status("lost"))
    dead.stage(status("x"), "x")
    running = S.Generation(spark, root)
    running.write("status", status("next"))
    removed = S.expire(spark, root, keep=2)
    assert len(removed) == 4 and any(f.startswith("_staging/") for f in removed)
    assert sorted(os.listdir(f"{root}/_commits"))[-1] == "000000004.json" and len(glob.glob(f"{root}/_commits/0*.json")) == 2
    assert [r.status for r in S.snapshot(spark, root).read("status").collect()] == ["s3"]
    running.commit("2026-01-02 00:00:00")
    assert [r.status for r in S.snapshot(spark, root).read("status").collect()] == ["next"]


def test_a_run_touches_what_it_must(spark, tmp_path):
    args = run_args(spark, tmp_path)
    daily.run_daily(spark, frame(spark, *CAST), ["ord"], now="2026-02-11 05:12:00", **args)
    before = S.snapshot(spark, args["state_root"])
    daily.run_daily(spark, frame(spark, posting(1, company="Larkspur", salary_text="31-38 LPA")), ["ord"], now="2026-02-12 05:12:00", **args)
    after = S.snapshot(spark, args["state_root"])
    same = [name for name in S.STORED if after.folders[name] == before.folders[name]]
    assert {"matches", "salaries", "salary_lookup_cache"} <= set(same)
    assert sum(after.folders["postings"][b] != f for b, f in before.folders["postings"].items()) == 1
    assert not os.path.exists(f"{args['state_root']}/_staging") or os.listdir(f"{args['state_root']}/_staging") == []


@pytest.mark.parametrize("count", [0, 1, 3, 300])
def test_lookup(spark, tmp_path, count, monkeypatch):
    root = str(tmp_path / "state")
    rows = upsert.upsert_postings(spark.createDataFrame([], POSTINGS), frame(spark, *[posting(i) for i in range(300)]), daily.ts("2026-01-01 00:00:00"), ["ord"])
    S.write_state({"postings": rows.select(*POSTINGS.fieldNames())}, root, "2026-01-01 00:00:00")
    keys = sorted(r.url_hash for r in rows.select("url_hash").collect())[:count]
    found = S.lookup(S.snapshot(spark, root), spark.createDataFrame([(k,) for k in [*keys, *keys, "ff" * 32, None]], "url_hash string"))
    assert sorted(r.url_hash for r in found.collect()) == keys and found.columns == POSTINGS.fieldNames()
    if count == 3:
        buckets = {k[0] for k in keys} | {"f"}
        assert {f.split("bucket=")[1][0] for f in found.inputFiles()} <= buckets
        assert f"EqualTo(url_hash,{keys[0]})" in plan(found) or f"In(url_hash" in plan(found)


# ---- landed files -----------------------------------------------------------------------------

def rss(*items):
    return "<rss><channel><title>feed</title>" + "".join(items) + "</channel></rss>"


def item(company, title, link, text="Hi"):
    return f"<item><title>{company}: {title}</title><link>{link}</link><description>{text}</description></item>\n"


def test_rss_of_any_size_keeps_its_order(spark, tmp_path, monkeypatch):
    land = tmp_path / "landing" / "weworkremotely"
    land.mkdir(parents=True)
    items = [item(f"c{n}", f"Product Manager {n}", f"https://x/{n % 50}", "y" * (n % 300)) for n in range(2000)]
    (land / "large.rss").write_text(rss(*items))
    (land / "b.rss").write_text(rss(item("z", "Product Owner", "https://x/1")))
    params = Params(enabled_sources=("weworkremotely",))
    whole = None
    for size in ("128m", "16k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        found, rejects = registry.ingest_sources(spark, str(tmp_path / "landing"), params)
        rows = found.orderBy("source_ord", *registry.ARRIVAL).collect()
        assert rejects.count() == 0 and len(rows) == 2001
        assert [r.company for r in rows] == ["z", *[f"c{n}" for n in range(2000)]]
        out = upsert.upsert_postings(spark.createDataFrame([], POSTINGS), found, daily.ts("2026-01-01 00:00:00"), ["source_ord", *registry.ARRIVAL]).collect()
        key = sorted((r.url, r.title, r.sightings) for r in out)
        whole = whole or key
        assert key == whole and ("https://x/1", "Product Manager 1951", 41) in key
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_unreadable_rss_items_are_rejects(spark, tmp_path):
    land = tmp_path / "landing" / "weworkremotely"
    land.mkdir(parents=True)
    cut = "<item><title>Larkspur: Product Manager</title><link>https://x/9</link>"
    (land / "a.rss").write_text(rss(item("a", "Product Owner", "https://x/1"), cut, item("b", "Product Owner", "https://x/2"),
                                    "<item><title>c: Product Owner</title><link>q</item>", item("d", "Gardener", "https://x/3"), cut))
    (land / "empty.rss").write_text("")
    (land / "none.rss").write_text(rss())
    found, rejects = registry.ingest_sources(spark, str(tmp_path / "landing"), Params(enabled_sources=("weworkremotely",)))
    assert sorted(r.company for r in found.collect()) == ["a", "b"]
    assert [(r.source, r.error) for r in rejects.collect()] == [("weworkremotely", "unreadable RSS item")] * 3


def jobs(feed, *rows):
    fields = {"himalayas": ("jobs", "title", "companyName", "applicationLink"), "jsearch": ("data", "job_title", "employer_name", "job_apply_link"),
              "arbeitnow": ("data", "title", "company_name", "url")}
    key, title, company, url = fields[feed]
    return {key: [{title: t, company: "Larkspur", url: u} for t, u in rows]}


def land(root, where, payload):
    path = root / "landing" / where
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(payload if isinstance(payload, str) else json.dumps(payload))


def found_of(spark, root, **params):
    found, rejects = registry.ingest_sources(spark, str(root / "landing"), Params(**params))
    return [(r.title, r.url) for r in found.orderBy("source_ord", *registry.ARRIVAL).collect()], rejects.collect()


def test_which_record_of_a_url_counts(spark, tmp_path):
    for feed in ("himalayas", "jsearch"):
        for k, rows in enumerate(([("A0", "u1"), ("B0", "u2")], [("A1", "u1"), ("C1", "u3"), ("D1", "")])):
            land(tmp_path, f"{feed}/keyword_ord={k}/page=1/a.json", jobs(feed, *rows))
    got, _ = found_of(spark, tmp_path, enabled_sources=("himalayas",))
    assert got[:3] == [("A0", "u1"), ("B0", "u2"), ("C1", "u3")] and len(got) == 4
    got, _ = found_of(spark, tmp_path, enabled_sources=("jsearch",))
    assert sorted(got) == [("A1", "u1"), ("B0", "u2"), ("C1", "u3")]


def test_caps_act_in_a_run(spark, tmp_path):
    for k in range(4):
        land(tmp_path, f"himalayas/keyword_ord={k}/a.json", jobs("himalayas", *[(f"t{k}{n}", f"u{k}{n}") for n in range(3)]))
        land(tmp_path, f"arbeitnow/page={k + 1}/a.json", jobs("arbeitnow", *[(f"Product Owner {k}{n}", f"v{k}{n}") for n in range(0 if k == 2 else 3)]) | {"meta": {"last_page": 9}})
    only = dict(enabled_sources=("himalayas",))
    assert len(found_of(spark, tmp_path, **only)[0]) == 12
    assert [t for t, _ in found_of(spark, tmp_path, per_source_cap=4, **only)[0]] == ["t00", "t01", "t02", "t10"]
    only = dict(enabled_sources=("arbeitnow",))
    assert len(found_of(spark, tmp_path, **only)[0]) == 9
    assert len(found_of(spark, tmp_path, max_pages=1, **only)[0]) == 3
    assert len(found_of(spark, tmp_path, max_pages=9, **only)[0]) == 6            # the empty page ends it
    assert [t[-2:] for t, _ in found_of(spark, tmp_path, per_source_cap=5, **only)[0]] == ["00", "01", "02", "10", "11"]


def test_a_corrupt_file_is_one_reject(spark, tmp_path):
    land(tmp_path, "arbeitnow/page=1/a.json", jobs("arbeitnow", ("Product Owner", "u1")))
    land(tmp_path, "himalayas/keyword_ord=0/a.json", jobs("himalayas", ("x", "u2")))
    packed = gzip.compress(json.dumps(jobs("arbeitnow", *[(f"Product Owner {n}", f"w{n}") for n in range(999)])).encode())
    (tmp_path / "landing/arbeitnow/page=2").mkdir()
    (tmp_path / "landing/arbeitnow/page=2/b.json.gz").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "landing/arbeitnow/page=3").mkdir()
    (tmp_path / "landing/arbeitnow/page=3/c.json.gz").write_bytes(gzip.compress(json.dumps(jobs("arbeitnow", ("Product Owner", "u3"))).encode()))
    got, rejects = found_of(spark, tmp_path, enabled_sources=("himalayas", "arbeitnow"))
    assert sorted(u for _, u in got) == ["u1", "u2", "u3"]
    assert [(r.source, os.path.basename(r.file), r.error) for r in rejects] == [("arbeitnow", "b.json.gz", "unreadable file")]


def test_large_payloads_give_what_small_ones_give(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"Product Owner {n}", f"https://x/{n % 900}") for n in range(3000)]
    payload = jobs("arbeitnow", *rows)
    for n, job in enumerate(payload["data"]):
        job |= {"description": "<p>" + "a}]\"{ \\ é🙂" * rng.randint(0, 200) + "</p>", "job_types": ["x", "y"], "tags": {"z": [1, {"q": None}]}}
    payload = {"links": {"data": [1]}, **payload, "meta": {"last_page": 3}}
    land(tmp_path, "arbeitnow/page=1/all.json", payload)
    land(tmp_path, "arbeitnow/page=2/cut.json", json.dumps(payload)[:-9])
    land(tmp_path, "arbeitnow/page=2/other.json", {"error": "quota"})
    (tmp_path / "landing/arbeitnow/page=3").mkdir()
    (tmp_path / "landing/arbeitnow/page=3/c.json.gz").write_bytes(gzip.compress(json.dumps(jobs("arbeitnow", ("Product Owner", "u3"))).encode()))
    land(tmp_path, "remoteok/a.json", [{"legal": "x"}, {"position": "Product Owner", "url": "u9"}])
    params = Params(enabled_sources=("remoteok", "arbeitnow"))
    both = []
    for large in (False, True):
        found, rejects = registry.ingest_sources(spark, str(tmp_path / "landing"), params, large=large)
        both.append((sorted(map(repr, found.drop("raw", "file").collect())), sorted((os.path.basename(r.file), r.pos, r.error) for r in rejects.collect())))
    assert both[0] == both[1] and len(both[0][0]) == 3002
    assert both[0][1] == [("cut.json", None, "invalid JSON"), ("other.json", None, "no readable record list")]


def size(root):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names)


def test_landed_sources_keep_little_on_disk(spark, tmp_path, monkeypatch):
    n, sf = 60_000, str(tmp_path / "in")
    day = F.timestamp_seconds(F.col("id") % 1000 * 86_400).cast("timestamp_ntz")
    spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") % 6000).alias("o_custkey"), day.alias("o_orderdate")).write.parquet(f"{sf}/orders.parquet")
    for module in (catalog, registry):
        monkeypatch.setattr(module, "work_dir", lambda spark, name: str(tmp_path / "work" / f"{name}-{uuid.uuid4().hex}"))
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    counts = {r.source: r["count"] for r in catalog.landed_sources(spark, sf).groupBy("source").count().collect()}
    # one record in 211 is cut off, remoteok's notices and empty titles, nameless himalayas and their repeated links go
    kept = [k for k in range(n) if k % 211]
    assert counts["arbeitnow"] == counts["weworkremotely"] == len(kept)
    assert counts["remoteok"] == sum(k % 89 != 0 and k % 500 != 1 for k in kept) and 0 < counts["himalayas"] < counts["arbeitnow"]
    assert size(tmp_path / "work") < 150 * 4 * n     # 535 bytes a record before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before


@pytest.mark.parametrize("name", ["himalayas", "remoteok", "weworkremotely", "arbeitnow"])
def test_payload_texts_shuffle_no_record(spark, tmp_path, name):
    day = F.timestamp_seconds(F.col("id")).cast("timestamp_ntz")
    rows = spark.range(50_000, 90_000, 7).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), day.alias("o_orderdate"))
    rows.unionAll(rows.limit(9)).write.parquet(f"{tmp_path}/orders.parquet")   # keys may repeat
    files = catalog.payload_texts(spark, str(tmp_path), name)
    steps = plan(files).splitlines()
    at = [i for i, step in enumerate(steps) if "Exchange" in step]
    assert len(at) == 1 and "FileScan" in steps[at[0] + 1]
    keys = [(r.keyword_ord, r.page, r.part) for r in files.collect()]
    assert len(keys) == len(set(keys)) == (4 * 3 if name == "weworkremotely" else 4 * 3 * 2)


def test_rows_are_not_shuffled_for_the_list_of_files(spark, tmp_path):
    rng = random.Random(3)
    for k in range(3):
        jobs_ = [{"title": f"Product Owner {n}", "company_name": rng.randbytes(90).hex(), "url": rng.randbytes(60).hex(), "description": rng.randbytes(200).hex()} for n in range(700)]
        land(tmp_path, f"arbeitnow/page={k}/a.json", {"data": jobs_})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        found, _ = registry.ingest_sources(spark, str(tmp_path / "landing"), Params(enabled_sources=("arbeitnow",)))
        assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)
        assert sorted({r.file_ord for r in found.select("file_ord").collect()}) == [1, 2, 3] and found.count() == 2100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_walker_at_any_cut(monkeypatch):
    items = [1, -2.5e10, "a}]\"{\\", {"jobs": [{"b}": [True, None]}]}, [], "é🙂", {}]
    text = json.dumps({"x": {"jobs": [7]}, "jobs": items, "meta": 12}, indent=1)
    for size in (1, 2, 7, 10_000):
        monkeypatch.setattr(payload_files, "READ_CHARS", size)
        assert [json.loads(t) for t in payload_files.records(io.StringIO(text), "jobs")] == items
        assert [json.loads(t) for t in payload_files.records(io.StringIO(json.dumps(items)), None)] == items
        for bad in ("", "{", '{"jobs":[}', '{"jobs":[1]} x', "<html>", '{"jobs":[1,]}', '{"jobs":[NaN]}', '{"jobs":[1 2]}', '{"jobs":[1],"b":2'):
            with pytest.raises(ValueError):
                list(payload_files.records(io.StringIO(bad), "jobs"))
        for other in ("{}", '{"jobs":{}}', "[1]", '{"a":1}', "12"):
            with pytest.raises(payload_files.NoRecords):
                list(payload_files.records(io.StringIO(other), "jobs"))


def test_cuts_of_a_configuration():
    assert params_from_config({}).role_text_chars == P.CUTS["role_text_chars"] and Params().role_text_chars is None
    assert params_from_config({"matching": {"role_text_chars": None}, "search": {"max_pages": 7}}).role_text_chars is None
    assert params_from_config({"search": {"max_pages": 7}}).max_pages == 7 and PARAMS.max_pages is None


# ---- streams --------------------------------------------------------------------------------------

def test_a_redelivered_batch_writes_nothing(spark, tmp_path):
    root = str(tmp_path / "state")
    send = lambda batch_id, n: ingest.apply_batch(spark, frame(spark, posting(n)), ["ord"], root, "2026-01-01 00:00:00", stream="s", batch_id=batch_id)
    assert [send(0, 1), send(1, 2)] == [1, 2]
    files = sorted(glob.glob(f"{root}/**", recursive=True))
    assert [send(1, 2), send(0, 1)] == [2, 2] and sorted(glob.glob(f"{root}/**", recursive=True)) == files
    assert S.snapshot(spark, root).streams == {"s": 1}


def test_rss_stream_equals_batch(spark, tmp_path):
    land = tmp_path / "landing" / "weworkremotely"
    land.mkdir(parents=True)
    (land / "1.rss").write_text(rss(item("a", "Product Owner", "https://x/1"), item("b", "Product Owner", "https://x/1"), "<item><title>"))
    drain = lambda: ingest.start_feed(
        spark, "weworkremotely", str(land), str(tmp_path / "state"), str(tmp_path / "rejects"), str(tmp_path / "c"), "2026-01-01 00:00:00").awaitTermination()
    drain()
    (land / "2.rss").write_text(rss(item("c", "Product Owner", "https://x/2")))
    drain()
    found, _ = registry.ingest_sources(spark, str(tmp_path / "landing"), Params(enabled_sources=("weworkremotely",)))
    batch = upsert.upsert_postings(spark.createDataFrame([], POSTINGS), found, daily.ts("2026-01-01 00:00:00"), ["source_ord", *registry.ARRIVAL])
    columns = ["url_hash", "url", "source", *REFRESHED]
    rows = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert rows(S.read_state(spark, str(tmp_path / "state"))["postings"]) == rows(batch) and len(rows(batch)) == 2
    assert [r.error for r in ingest.read_rejects(spark, str(tmp_path / "rejects")).collect()] == ["unreadable RSS item"]


# ---- what a query makes once ------------------------------------------------------------------

@pytest.fixture(scope="module")
def odd_orders(spark, tmp_path_factory):
    """Orders before and after the split day: repeated ones, and ones without a key, customer or day."""
    path = str(tmp_path_factory.mktemp("odd"))
    made = spark.range(60).select(
        F.when(F.col("id") % 13 != 0, F.col("id") % 50).alias("o_orderkey"), F.when(F.col("id") % 11 != 0, F.col("id") % 7).alias("o_custkey"),
        F.when(F.col("id") % 17 != 0, F.expr("timestamp_ntz'1995-12-20 00:00:00' + make_dt_interval(cast(id % 25 as int))")).alias("o_orderdate"))
    made.coalesce(1).write.parquet(f"{path}/orders.parquet")
    return path


def test_state_write_makes_each_state_once(spark, odd_orders, monkeypatch):
    upserts, written, upserted, write_state = [], [], upsert.upsert_postings, S.write_state
    monkeypatch.setattr(upsert, "upsert_postings", lambda *a: upserts.append(a) or upserted(*a))
    monkeypatch.setattr(S, "write_state", lambda tables, *a: written.append(tables) or write_state(tables, *a))
    counts = {r.state_table: r.stored for r in catalog.state_write(spark, odd_orders).collect()}
    assert len(upserts) == 2
    first, second = written
    assert not [df for df in (first["postings"], first["matches"], second["postings"]) if "orders.parquet" in plan(df)]
    for made, want in ((first["postings"], catalog.state1), (first["matches"], catalog.matches1), (second["postings"], catalog.state2)):
        assert sorted(map(str, made.collect())) == sorted(map(str, want(spark, odd_orders).collect())) and made.count() > 0
    assert (counts["matches"], counts["salaries"]) == (first["matches"].count(), 0)


def test_rss_items_are_parsed_once(spark, tmp_path):
    whole = "<item><title>Acme: Engineer</title><link>u</link></item>"
    texts = [None, "", " ", "<item>", "<item></item>", "<item><title>Acme</title></item>", whole, whole]
    items = feeds.parse_rss(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ord int, text string"), "text")
    found = feeds.weworkremotely(items)
    assert optimized(found).count("from_xml(") == 1 and optimized(catalog.union_sources(spark, SF)).count("from_xml(") == 1
    broken = items.filter("item IS NULL OR item._corrupt_record IS NOT NULL").select("ord").collect()
    assert sorted(r.ord for r in broken if r.ord != 0) == [1, 2, 3] and items.filter("ord = 0 AND item IS NULL").count() == 1
    assert {r.ord: (r.company, r.title, r.url) for r in found.filter("ord > 3").collect()} == {
        4: ("Unknown", "", ""), 5: ("Unknown", "Acme", ""), 6: ("Acme", "Engineer", "u"), 7: ("Acme", "Engineer", "u")}

    (tmp_path / "feed.xml").write_text(f"<rss><channel>{whole}<item><title>cut {whole}{whole}<item><title>Acme: </title></item></channel></rss>")
    (tmp_path / "empty.xml").write_text("")
    rows = feeds.parsed(feeds.read_landed(spark, "weworkremotely", str(tmp_path)), "weworkremotely", catalog.ANY_TITLE)
    text = optimized(rows)
    assert (text.count("from_xml("), text.count("split(value")) == (1, 1)
    assert [(r.company, r.title, r.error) for r in rows.orderBy("pos", F.col("error").isNull()).collect()] == [
        ("Acme", "Engineer", None), ("Unknown", "", "unreadable RSS item"), ("Acme", "Engineer", None), ("Acme", "Engineer", None), ("Unknown", "Acme:", None)]
