"""Exact dedup, mixing, sharding and line dedup against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from articlelab.llm import exact_dedup, line_dedup, mixing, sharding


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_content_sort_matches_grouping(sf001, rows, keep):
    out = exact_dedup.content_sort_dedup(sf001[0], keep=keep).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[t or ""].append(i)
    pick = min if keep == "smallest" else max
    best = {hashlib.sha256(t.encode()).hexdigest(): (pick([i for i in ids if i is not None], default=None), len(ids)) for t, ids in groups.items()}
    assert len(out) == len(rows)
    assert all((r.keep_id, r.group_size) == best[r.text_sha256] for r in out)
    kept = Counter(r.text_sha256 for r in out if r.kept)
    assert kept == Counter(best.keys())  # one row of each text, repeated rows included
    assert all(r.doc_id == r.keep_id for r in out if r.kept)


def test_content_sort_hot_text_and_normaliser(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(" Hot  text")).otherwise(
        F.when(F.col("id") % 3 == 1, F.lit("hot text")).otherwise(F.concat(F.lit("t"), "id"))).alias("text"))
    out = exact_dedup.content_sort_dedup(docs, normalise="lower_space").filter("group_size > 1").agg(
        F.count("*"), F.min("keep_id"), F.max("group_size"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(out) == (2667, 0, 2667, 1)


def test_content_sort_refuses_another_law(sf001):
    with pytest.raises(ValueError):
        exact_dedup.content_sort_dedup(sf001[0], keep="any")


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = float(cap * sizes[s])
            left -= target[s]
            free.remove(s)
        if not free:
            return target


def test_mixing_targets_and_copies(sf001, rows):
    out = mixing.with_copies(sf001[0]).select("doc_id", "source", "_size", "_target", "_source_size", "_copies").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = brute_targets(sizes)
    for r in out:
        assert r._source_size == sizes[r.source]
        assert r._target == pytest.approx(want[r.source])
        rate = r._target / r._source_size if r._source_size else 0.0
        u = int(hashlib.md5(f"mix-1:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        assert r._copies == math.floor(rate) + (u < rate - math.floor(rate)) <= 3
    mixed = Counter(r.doc_id for r in mixing.mix(sf001[0]).collect())
    assert sum(mixed.values()) == sum(r._copies for r in out)


def test_capped_sources_share_their_excess(spark):
    docs = spark.createDataFrame([(1, "a", "s1"), (2, "b " * 1000, "s2"), (3, "c " * 10, "s3"), (4, None, None)], "doc_id long, text string, source string")
    got = {r["source"]: r["_target"] for r in mixing.with_copies(docs).collect()}
    want = brute_targets({"s1": 1, "s2": 1000, "s3": 10, None: 0})
    assert got == pytest.approx(want)
    assert got["s1"] == 3 and got["s3"] == 30 and got["s2"] == 978


def test_shards_are_near_equal_and_keep_equal_texts_together(sf001, rows):
    out = sharding.kd_shards(sf001[0], n_shards=4).collect()
    assert len(out) == len(rows)
    size, slots = Counter(), defaultdict(list)
    for r in out:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert want == Counter((r.doc_id, r.size, r.text_crc32) for r in out)
    # two rows of one very long text are more than half of all bytes: without them sizes are near equal
    short = sharding.kd_shards(sf001[0].filter("doc_id is null or doc_id not in (10005, 10006)"), n_shards=4).collect()
    size, text, shards = Counter(), {i: t for i, t, _ in rows}, defaultdict(set)
    for r in short:
        size[r.shard] += r.size
        if text.get(r.doc_id):
            shards[text[r.doc_id]].add(r.shard)
    assert len(size) == 4 and max(size.values()) < 1.05 * min(size.values())
    assert all(len(v) == 1 for v in shards.values())


def brute_kd(points, dims, leaves, first=0):
    """Recursive weighted medians on (key per dimension, bytes, name) points."""
    if leaves == 1 or not points:
        return {p["name"]: first for p in points}
    left = leaves // 2
    total = sum(p["bytes"] for p in points)
    want = left / leaves * total
    by_width = sorted(dims, key=lambda d: (-(max(p[d] for p in points) - min(p[d] for p in points)) / p_span[d], dims.index(d)))
    best = None
    for d in by_width:
        if best is not None and best[0] <= 0.01 * total / leaves:
            break
        run, ordered = 0, sorted(points, key=lambda p: p["key_" + d])
        for i, p in enumerate(ordered):
            below, run = run, run + p["bytes"]
            if run >= want or i == len(ordered) - 1:
                miss, cut = min((abs(run - want), p["key_" + d]), (abs(below - want), p["key_" + d] - 1))
                break
        if best is None or miss < best[0]:
            best = (miss, d, cut)
    _, d, cut = best
    return brute_kd([p for p in points if p["key_" + d] <= cut], dims, left, first) | brute_kd(
        [p for p in points if p["key_" + d] > cut], dims, leaves - left, first + left)


p_span = {}


def test_kd_leaves_equal_a_recursive_version(spark):
    df = spark.range(300).select(
        F.col("id").cast("string").alias("_tie"), (F.pmod(F.xxhash64("id"), F.lit(900)) + 1).alias("_bytes"),
        (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)).cast("double")).alias("a"), (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(7)).cast("double")).alias("b"))
    low = {d: df.agg(F.min(d)).first()[0] for d in "ab"}
    for d in "ab":
        p_span[d] = df.agg(F.max(d)).first()[0] - low[d]
    top = (1 << sharding.STEPS_BITS) - 1
    keyed = df.select("*", *[(F.shiftleft(F.floor((F.col(d) - low[d]) / p_span[d] * top).cast("long"), sharding.TIE_BITS)
                             + F.pmod(F.xxhash64(F.lit(d), "_tie"), F.lit(1 << sharding.TIE_BITS))).alias("key_" + d) for d in "ab"])
    points = [r.asDict() | {"name": r["_tie"], "bytes": r["_bytes"]} for r in keyed.collect()]
    got = {r["_tie"]: r["_leaf"] for r in sharding.kd_leaves(df, ["a", "b"], 6).collect()}
    assert got == brute_kd(points, ["a", "b"], 6)


def test_a_group_too_large_for_a_leaf_is_cut(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1200, F.lit("the same text " * 3)).otherwise(
        F.concat(F.lit("text "), "id", F.lit(" " * 37))).alias("text"))
    out = sharding.kd_shards(docs, n_shards=8).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    sizes = [r["s"] for r in out]
    assert len(sizes) == 8 and max(sizes) < 1.15 * min(sizes)


def test_target_bytes_gives_the_number_of_shards(sf001):
    total = sharding.kd_shards(sf001[0], n_shards=1).agg(F.sum("size")).first()[0]
    assert sharding.kd_shards(sf001[0], target_bytes=total // 3 + 1).select("shard").distinct().count() == 3


def test_lines_over_the_ratio_go(spark):
    pages = spark.createDataFrame(
        [(i, f"http://H.example/{i}", f"<p>menu</p>\n<p>story {i}</p><script>menu2</script><p>menu</p>") for i in range(20)]
        + [(100, "http://b.example/", "<p>menu</p>"), (101, None, "<p>menu</p>"), (102, "not a url", None), (103, "http://H.example:8080/z", "")],
        "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("_lines", F.lit(1))
    got = {r["page_id"]: r for r in line_dedup.site_line_dedup(pages).collect()}
    assert [got[3][c] for c in ("host", "n_lines", "n_dropped", "kept_text")] == ["h.example", 3, 2, "story 3"]
    assert got[100]["kept_text"] == "menu" and got[101]["host"] == "" and got[102]["n_lines"] == 0 and got[103]["host"] == "h.example"
    assert line_dedup.site_line_dedup(pages.limit(0)).count() == 0


def test_boilerplate_beyond_the_bytes_of_a_broadcast(spark, monkeypatch):
    from articlelab.llm import common
    long = "long line " * 200
    pages = [(i, f"http://h{i % 4}.example/{i}", f"<p>menu</p><p>{long}{i % 4}</p><p>story {i}</p><p>menu</p><p>part {i % 8}</p>") for i in range(64)]
    pages += pages[:5] + [(0, "http://h0.example/other", "<p>menu</p>"), (100, None, None), (100, None, ""), (None, "http://h1.example", "<p>menu</p>x"),
                          (None, "http://h1.example", "<p>menu</p>x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    lines = lambda h: [x.strip() for x in re.split(r"<[^>]*>|[\r\n]+", h or "") if x.strip()]
    host = lambda u: (u or "://").split("://")[1].split("/")[0]
    n, of = Counter(host(u) for _, u, _ in pages), Counter((host(u), x) for _, u, h in pages for x in set(lines(h)))
    want = Counter()
    for i, u, h in pages:
        kept = [x for x in lines(h) if not (of[host(u), x] >= 2 and of[host(u), x] / n[host(u)] > 0.1)]
        want[i, host(u), len(lines(h)), len(lines(h)) - len(kept), "\n".join(kept)] += 1
    for budget in (1 << 20, 4000, 0):  # all, some, none of the lists by broadcast
        monkeypatch.setattr(common, "BROADCAST_BYTES", budget, raising=False)
        out = line_dedup.site_line_dedup(df)
        assert Counter(map(tuple, out.collect())) == want
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == (budget <= 4000)


def test_hosts_with_long_lists_of_boilerplate(spark, monkeypatch):
    """Over LIST_LINES lines the pages' lines are joined, with the same result; a page of 20,000 lines."""
    pages = [(i, f"http://h{i % 2}.example/{i}", "".join(f"<p>line {k}</p>" for k in range(i % 3, 40)) + f"<p>story {i}</p>") for i in range(12)]
    pages += [(99, "http://h0.example/long", "".join(f"<p>own {k}</p><p>line {k % 50}</p>" for k in range(10_000)))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    want = Counter(map(tuple, line_dedup.site_line_dedup(df).collect()))
    monkeypatch.setattr(line_dedup, "LIST_LINES", 5)
    assert Counter(map(tuple, line_dedup.site_line_dedup(df).collect())) == want
    row = next(r for r in want if r[0] == 99)
    assert row[2:4] == (20_000, 8_000) and "line 45" in row[4] and "line 3\n" not in row[4]


def test_lines_on_two_pages_go_and_open_markup_ends_with_the_page(spark):
    pages = [(1, "http://a.example/1", "<p>menu</p><p>one</p><SCRIPT>var menu"), (2, "http://a.example/2", "<p>menu</p>two<!-- <p>menu</p> rest"),
             (3, "http://b.example/", "<p>menu</p>" + "<!--" * 50_000)]
    got = {r["page_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup.site_line_dedup(
        spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: (2, 1, "one"), 2: (2, 1, "two"), 3: (1, 0, "menu")}


def test_large_lookups_join_by_salt(spark, monkeypatch):
    from articlelab.llm import common
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), [None, "a", "b"][i % 3]) for i in range(60)], "doc_id long, text string, source string")
    salted = {(r["doc_id"], r["_copies"], r["_target"]) for r in mixing.with_copies(docs).collect()}
    monkeypatch.undo()
    assert salted == {(r["doc_id"], r["_copies"], r["_target"]) for r in mixing.with_copies(docs).collect()}


def test_empty_and_clashing(empty, clashing):
    assert exact_dedup.content_sort_dedup(empty).count() == 0
    assert mixing.mix(empty).count() == 0 and mixing.mix(clashing).columns == clashing.columns
    assert mixing.mix(clashing).count() >= 0
    assert sharding.kd_shards(empty, n_shards=8).count() == 0
    assert exact_dedup.content_sort_dedup(clashing).filter("kept").count() == 2
    assert sharding.kd_shards(clashing, n_shards=2).count() == 3


def test_native_plans_have_no_python(sf001):
    pages = sf001[0].select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h.example/"), "doc_id").alias("url"), F.col("text").alias("html"))
    for df in (exact_dedup.content_sort_dedup(sf001[0]), mixing.mix(sf001[0]), line_dedup.site_line_dedup(pages), sharding.kd_shards(sf001[0], n_shards=4)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
