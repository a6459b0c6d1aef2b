"""Whitening, Merkle manifest and URL filter against brute force."""

import math
import re
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from articlelab.llm import manifest, url_filter, whitening

# --- whitening -------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def _expected(vectors):
    """{row number: (n, deviation)}, eigenvalues and projections by numpy."""
    x = np.floor(1024 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    dev = n * x - s
    v = (dev / n).T @ (dev / n) / n
    e, q = np.linalg.eigh(v)
    return n, (dev.astype(object) ** 2).sum(axis=1), e[::-1], (dev / n) @ q[:, ::-1]


@pytest.mark.parametrize("case", range(40))
def test_rank_one_updates_give_the_eigendecomposition(case):
    rng = np.random.default_rng(case)
    d, n = int(rng.integers(1, 14)), int(rng.integers(1, 60))
    x = rng.integers(-4, 5, (n, d)) if case % 2 else np.floor(rng.normal(size=(n, d)) * 1024).astype(np.int64) + 100_000
    if case % 3 == 0:
        x = np.concatenate([x, x[:1], x[:1], x])
    own = whitening.Spectrum.empty(d)
    own.add_rows(x.astype(np.int64))
    a, b = whitening.Spectrum.empty(d), whitening.Spectrum.empty(d)
    a.add_rows(x[: n // 2].astype(np.int64))
    b.add_rows(x[n // 2:].astype(np.int64))
    a.add(b)
    c = x - x.mean(axis=0)
    want = c.T @ c
    size = max(1.0, np.abs(want).max())
    for got in (own, a):
        assert got.n == len(x) and got.sums == x.sum(axis=0).tolist()
        assert np.abs(got.vectors * got.values @ got.vectors.T - want).max() < 1e-11 * size
        assert np.abs(got.vectors.T @ got.vectors - np.eye(d)).max() < 1e-12
        assert np.abs(got.values - np.linalg.eigvalsh(want)).max() < 1e-11 * size


def test_secular_roots_between_poles():
    rng = np.random.default_rng(5)
    for gap in (1.0, 1e-6, 1e-11):
        d = np.cumsum(rng.uniform(0.5, 1, 20) * gap) + 3
        w = rng.uniform(0, 1, 20) ** 8 + 1e-30
        pole, offset, _ = whitening.secular_roots(d, w)
        root = d[pole] + offset
        assert (root[:-1] >= d[:-1]).all() and (root[:-1] <= d[1:]).all() and root[-1] > d[-1]
        assert math.isclose(root.sum(), d.sum() + w.sum(), rel_tol=1e-12)


def _check(spark, df, vectors):
    out = whitening.whiten(df).collect()
    n, dev, e, y = _expected(vectors)
    k = min(8, len(vectors[0]))
    assert len(out) == len(vectors) * k
    got = defaultdict(list)
    for r in out:
        got[r["vec_id"], r["component"]].append(r)
    for i in range(len(vectors)):
        for c in range(1, k + 1):
            r = next(r for r in got[i, c])
            assert (r["n"], r["deviation"]) == (n, dev[i])
            assert math.isclose(r["explained"], e[c - 1] / e.sum(), rel_tol=1e-9)
            assert math.isclose(abs(r["whitened"]), abs(y[i, c - 1]) / math.sqrt(e[c - 1]), rel_tol=1e-6, abs_tol=1e-6)
            assert r["identity_error"] < 1e-9
    return out


def test_whitening_of_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = sorted(df.collect(), key=lambda r: r["vec_id"])
    assert [r["vec_id"] for r in rows] == list(range(len(rows)))
    _check(spark, df, [r["embedding"] for r in rows])


def test_whitening_is_the_same_on_any_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(90)
    key = lambda rows: {(r["vec_id"], r["component"]): r["whitened"] for r in rows}
    few, many = key(whitening.whiten(df.repartition(1)).collect()), key(whitening.whiten(df.repartition(23)).collect())
    assert few.keys() == many.keys()
    assert max(abs(few[k] - many[k]) for k in few) < 1e-7


def test_whitening_of_awkward_rows(spark):
    good = [[float(i % 5), float(i * i % 7), 0.25 * (i % 3)] for i in range(12)]
    rows = [(i, v, 0) for i, v in enumerate(good)]
    bad = [(90, None, 1), (91, [], 1), (92, [1.0, None, 2.0], 1), (93, [float("nan"), 0.0, 0.0], 1), (94, [float("inf"), 0.0, 0.0], 1),
           (95, [1.0, 2.0], 1), (None, good[3], 1), (3, good[3], 1)]
    df = spark.createDataFrame(rows + bad, VECTORS).withColumns({c: F.lit("clash") for c in ("n", "component", "whitened", "part", "sums")})
    out = whitening.whiten(df).collect()
    assert Counter(r["vec_id"] for r in out) == Counter({i: 3 for i in range(12)}) + Counter({3: 3, None: 3})
    n, dev, e, _ = _expected(good + [good[3], good[3]])
    assert {r["n"] for r in out} == {n} and {r["deviation"] for r in out if r["vec_id"] is None} == {dev[3]}
    assert math.isclose(next(r["explained"] for r in out if r["component"] == 1), e[0] / e.sum(), rel_tol=1e-9)


def test_whitening_without_variance(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 0)], VECTORS)).collect()
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [
        (1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 0.0], 0) for i in range(4)], VECTORS)).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in flat)
    assert math.isclose(flat[0]["explained"] + flat[1]["explained"], 1.0)
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], VECTORS)).count() == 0


def test_deviations_beyond_64_bits_are_null(spark):
    rows = [(i, [float(2**37) * (-1) ** i, 1.0], 0) for i in range(4)]
    out = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r["deviation"] for r in out} == {None} and all(math.isclose(abs(r["whitened"]), 1.0) for r in out if r["component"] == 1)


# --- manifest --------------------------------------------------------------

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _tree(leaves):
    """Root and, per leaf, [(siblings left, siblings right)] by plain recursion."""
    proofs = [[] for _ in leaves]
    level, members = list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        up, groups = [], []
        for i in range(0, len(level), 2):
            run = level[i:i + 2]
            for j in range(len(run)):
                for m in members[i + j]:
                    proofs[m].append((run[:j], run[j + 1:]))
            up.append(_h(*run))
            groups.append([m for j in range(len(run)) for m in members[i + j]])
        level, members = up, groups
    return level[0], proofs


def _manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(r)
    langs = sorted(by, key=lambda v: (v is not None, (v or "").encode()))
    value = lambda r, found: [r[c] + 1 if found and c == "n_chars" and r[c] is not None and r["doc_id"] is not None
                              and crc32(str(r["doc_id"]).encode()) % 7 == 0 else r[c] for c in COLUMNS]
    trees = {}
    for g in langs:
        own = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, _leaf(value(r, False)), _leaf(value(r, True)), r["doc_id"]) for r in by[g]))
        trees[g] = own, *_tree([o[2] for o in own])
    root, above = _tree([trees[g][1] for g in langs])
    out = []
    for g, top in zip(langs, above, strict=True):
        own, sub, proofs = trees[g]
        for (_, _, leaf, found, doc_id), proof in zip(own, proofs, strict=True):
            whole = proof + top
            d = found
            for left, right in whole:
                d = _h(*left, d, *right)
            out.append((doc_id, leaf, sub, root, _h(*[x for lr in whole for side in lr for x in side]), d, d == root))
    return out


def _tampered():
    return {"n_chars": F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0, F.col("n_chars") + 1)
            .otherwise(F.col("n_chars"))}


@pytest.mark.parametrize("bits", [1, 3, manifest.BLOCK_BITS])
def test_manifest_against_recursion(sf001, bits):
    docs, _ = sf001
    got = [tuple(r) for r in manifest.manifest(docs, COLUMNS, changed=_tampered(), bits=bits).collect()]
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted(got, key=key) == sorted(_manifest(docs.collect()), key=key)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_small_tables(spark, empty, clashing):
    assert manifest.manifest(empty, COLUMNS).count() == 0
    one = clashing.filter("doc_id = 3")
    r = manifest.manifest(one, COLUMNS).collect()
    leaf = _leaf([3, None, "en", 5, "other words entirely here now"])
    assert [tuple(x) for x in r] == [(3, leaf, leaf, leaf, _h(""), leaf, True)]
    got = sorted(tuple(x) for x in manifest.manifest(clashing, COLUMNS).collect())
    assert [g[1] for g in got] == [_leaf([r[c] for c in COLUMNS]) for r in sorted(clashing.collect(), key=lambda r: r["doc_id"])]
    assert all(g[6] for g in got)


def test_manifest_of_many_groups_and_equal_rows(spark):
    rows = [(i % 3, "s", f"lang{i % 37}", i, "t") for i in range(150)] + [(5, "s", "lang1", 1, "same")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    got = Counter(tuple(r) for r in manifest.manifest(docs, COLUMNS, changed=_tampered(), bits=2).collect())
    assert got == Counter(_manifest([dict(zip(COLUMNS, r, strict=True)) for r in rows]))


def test_sweeps_keep_label_order():
    for n in (1, 2, 3, 5, 8, 13):
        leaves = [_h(str(i)) for i in range(n)]
        climb = manifest.levels_of(n, 12)
        known = manifest.sweep_up(leaves, climb)
        root, _ = _tree(leaves)
        assert known[climb, 0] == root
        for leaf, steps in zip(leaves, manifest.sweep_down(known, n, climb, []), strict=True):
            assert manifest.fold(leaf, steps) == root


# --- URL filter ------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def _parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):]).group()


def _rule(host, path):
    fits = [(name + start, verdict) for verdict, name, start in url_filter.RULES
            if (host == name or host.endswith("." + name)) and path.startswith(start)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def _verdicts(pages, links, steps):
    """Dense PageRank over all hosts. links: page number -> hosts linked to."""
    parts = [_parts(u) for _, u, _ in pages]
    hosts = sorted({h for h, _ in parts if h} | {t for ts in links.values() for t in ts})
    at = {h: i for i, h in enumerate(hosts)}
    n = len(hosts)
    count, seeds, total = np.zeros((n, n)), {"allow": np.zeros(n), "block": np.zeros(n)}, np.zeros(n)
    for i, (h, p) in enumerate(parts):
        if h:
            total[at[h]] += 1
            if v := _rule(h, p)[1]:
                seeds[v][at[h]] += 1
            for t in set(links.get(i, ())):
                if t != h:
                    count[at[h], at[t]] += 1
    share = lambda m: np.divide(m, m.sum(axis=1, keepdims=True), out=np.zeros_like(m), where=m.sum(axis=1, keepdims=True) > 0)
    score = {}
    for kind, seed, m in (("trust", seeds["allow"], share(count)), ("distrust", seeds["block"], share(count.T))):
        s = 0.15 * np.divide(seed, total, out=np.zeros(n), where=total > 0)
        x = s.copy()
        for _ in range(steps):
            x = s + 0.85 * (x @ m)
        score[kind] = x
    out = []
    for (h, p), (page, _, _) in zip(parts, pages, strict=True):
        rule, verdict = _rule(h, p)
        if verdict is None:
            bad = h and score["distrust"][at[h]] >= 0.075 and score["distrust"][at[h]] > score["trust"][at[h]]
            verdict = "block" if bad else "allow"
        out.append((page, h, p, rule, verdict))
    return out, {h: (score["trust"][i], score["distrust"][i]) for h, i in at.items()}


def _fixture():
    """A ring of good hosts, one of bad ones, hosts that link to either."""
    pages, links = [], {}

    def page(url, targets=(), form='<a href="http://{}/x">'):
        links[len(pages)] = list(targets)
        pages.append((len(pages), url, "<p>" + "".join(form.format(t) for t in targets)))

    for i in range(6):
        page(f"http://bad{i}.net/es/1", [f"bad{(i + 1) % 6}.net"])
        page(f"http://bad{i}.net/other", [f"farm{i}.org"])
        page(f"http://good{i}.com/a", [f"good{(i + 1) % 6}.com", f"mid{i}.org"])
        page(f"http://farm{i}.org/a", [f"bad{i}.net", f"bad{(i + 2) % 6}.net"], '<IMG SRC = "//{}">')
        page(f"http://mid{i}.org/a", [f"good{i}.com", "bad0.net"] if i % 2 else [f"good{i}.com"], "<form action='HTTPS://{}?q'>")
        page(f"https://new{i}.org", ["farm0.org"] * 3)
    for url in (None, "", "no scheme", "http://", "http:///path", "ftp://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://a.example.com/en/b",
                "http://example.com/de/", "http://example.com?x=/en/", "http://net/es/", "http://xnet/es/", "http://a.b.net/fr/q", "http://com#/", "http://x.com:80/",
                "x://y://z/é/"):
        page(url)
    pages.append((len(pages), "http://bad0.net/zzz", None))
    pages.append((None, "http://farm1.org/q", ""))
    pages.append(pages[3])
    return pages, links | {len(pages) - 1: links[3]}


def test_url_verdicts_against_dense_pagerank(spark):
    pages, links = _fixture()
    df = spark.createDataFrame(pages, PAGES).withColumns({c: F.lit("clash") for c in ("host", "kind", "score", "verdict", "_rule", "source")})
    got = url_filter.filter_urls(df, steps=6).collect()
    want, scores = _verdicts(pages, links, 6)
    key = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    for r in got:
        t, d = scores.get(r["host"], (0, 0))
        assert math.isclose(r["trust"], t, abs_tol=1e-12) and math.isclose(r["distrust"], d, abs_tol=1e-12)
    open_ = {r["host"]: r["verdict"] for r in got if r["rule"] is None}
    assert open_["farm2.org"] == "block" and open_["mid0.org"] == "allow" and open_["bad1.net"] == "block"


def test_url_filter_large_lookups_join_with_salts(spark, monkeypatch):
    from articlelab.llm import common
    pages, links = _fixture()
    df = spark.createDataFrame(pages, PAGES)
    want = sorted(map(str, url_filter.filter_urls(df, steps=2).select("page_id", "host", "verdict").collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    assert sorted(map(str, url_filter.filter_urls(df, steps=2).select("page_id", "host", "verdict").collect())) == want


def test_url_filter_of_an_empty_table_and_native_plan(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], PAGES)).count() == 0
    plan = url_filter.filter_urls(spark.createDataFrame(_fixture()[0][:3], PAGES), steps=1)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
