"""Repeated byte strings and near-duplicates against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from articlelab.llm import near_dedup as N
from articlelab.llm import repeat_index as R


def covered(texts, length):
    counts = Counter(t[j:j + length] for t in texts for j in range(len(t) - length + 1))
    out = []
    for t in texts:
        out.append(R.merged([(j, j + length) for j in range(len(t) - length + 1) if counts[t[j:j + length]] > 1]))
    return out


def digest(text, spans):
    at, h = 0, hashlib.sha256()
    for a, b in spans:
        h.update(text[at:a])
        at = b
    return h.update(text[at:]) or h.hexdigest()


@settings(max_examples=120, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=60).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=6), st.integers(1, 12))
def test_matching_statistics(strings, length):
    index = R.RunLengthIndex(strings, depth=length)
    text = [(k, i) for k, s in enumerate(strings) for i in range(len(s))]
    ms = index.matching_statistics()
    for k, i in text:
        own, best = strings[k][i:], 0
        for q, j in text:
            if (q, j) != (k, i):
                other = strings[q][j:]
                n = 0
                while n < min(len(own), len(other)) and own[n] == other[n]:
                    n += 1
                best = max(best, n)
        got = ms[index.starts[k] + i]
        assert got == best if best >= length else got < length
    assert [R.merged(s) for s in index.repeats()] == covered(strings, length)
    assert sum(index.lengths) == sum(max(len(s) - length + 1, 0) for s in strings) and (np.diff(index.heads) != 0).all()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=30).map(lambda b: bytes(x % 3 + 97 for x in b)), st.integers(1, 3)), min_size=1, max_size=6), st.integers(1, 9))
def test_multiplicity_equals_copies(pairs, length):
    strings, times = [p for p, _ in pairs], [t for _, t in pairs]
    index = R.RunLengthIndex(strings, times, length)
    want = covered([p for p, t in pairs for _ in range(t)], length)
    firsts = np.cumsum([0, *times[:-1]])
    assert [R.merged(s) for s in index.repeats()] == [want[i] for i in firsts]
    assert sum(index.lengths) == sum(t * max(len(s) - length + 1, 0) for s, t in pairs)


def test_copies_are_marked_by_the_index(spark, monkeypatch):
    """Without the index (no match is long enough) nothing is found, equal texts included."""
    text = "".join(f"word {i * i} and " for i in range(200))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "ab" * 300), (4, "nothing of it")], "doc_id long, text string")
    spans = lambda: {r["doc_id"]: list(zip(r["starts"], r["ends"])) for r in R.repeated_spans(docs).collect()}
    assert spans() == {1: [(0, len(text))], 2: [(0, len(text))], 3: [(0, 600)], 4: []}
    plain = R._indexed
    monkeypatch.setattr(R, "_indexed", lambda pieces, length, size: plain(pieces, length, size).limit(0))
    assert not any(spans().values())


def test_anchor_is_shared_by_equal_strings():
    rng = np.random.default_rng(1)
    common = rng.integers(97, 123, 260, np.uint8)
    one, two = (np.concatenate([rng.integers(97, 123, n, np.uint8), common, rng.integers(97, 123, 90, np.uint8)]) for n in (50, 333))
    own = R.Anchors()
    seen = []
    for data, at in ((one, 50), (two, 333)):
        f, first, n = own.pieces(data)
        assert n.sum() == len(data) - R.LENGTH + 1 and first[0] == 0
        owner = np.repeat(f, n)
        seen.append(owner[at:at + 260 - R.LENGTH + 1].tolist())
    assert seen[0] == seen[1]


@pytest.mark.parametrize("most", [R.MOST_PIECES, 3, 0])
def test_repeats_on_documents(sf001, rows, most):
    docs = [(i, (t or "").encode()) for i, t, _ in rows]
    got = sorted((str(r["doc_id"]), r["n_bytes"], list(zip(r["starts"], r["ends"])), r["kept_sha256"]) for r in R.repeated_spans(sf001[0], most_pieces=most).collect())
    spans = covered([t for _, t in docs], 200)
    assert got == sorted((str(i), len(t), s, digest(t, s)) for (i, t), s in zip(docs, spans))


def test_long_runs_and_chunks(spark, monkeypatch, empty, clashing):
    monkeypatch.setattr(R, "CHUNK", 300)
    texts = ["x" * 1000, "y" * 199, "ab" * 300, "z" * 250 + "q", "p" + "z" * 250, "short"]
    texts += ["".join(chr(97 + (i * i + i // 7) % 26) for i in range(2000)), "HEAD" + "".join(chr(97 + (i * i + i // 7) % 26) for i in range(400, 1200)) + "TAIL"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: list(zip(r["starts"], r["ends"])) for r in R.repeated_spans(docs, index_bytes=500).collect()}
    assert [got[i] for i in range(len(texts))] == covered([t.encode() for t in texts], 200)
    assert R.repeated_spans(empty).count() == 0 and R.repeated_spans(clashing).count() == 3


def sets_of(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute_components(docs, width):
    sets, parent = [sets_of(t, width) for _, t in docs], list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs)}


@pytest.mark.parametrize("width", [2, 5])
def test_components_on_documents(sf001, rows, width):
    docs = [(i, t) for i, t, _ in rows if i is not None]
    want = brute_components(docs, width)
    out = N.near_duplicates(sf001[0], width=width).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def chain(n, size=100, step=4):
    """Texts of which neighbours are similar and the ends are not."""
    return [" ".join(f"w{i}" for i in range(k * step, k * step + size)) for k in range(n)]


def test_chains_join_in_small_blocks(spark):
    docs = list(enumerate(chain(40) + chain(3, 50, 25)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_components(docs, 2)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(df, width=2, block=4).collect()}
    assert got == want and want[39][1] == 0


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(7, i) for i in range(200, 260)]
    got = {r["id"]: r["c"] for r in N.components(spark.createDataFrame(path + hub + [(300, 300)], "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(200, 260)) and 300 not in got


def test_estimate_is_collision_corrected():
    rng = np.random.default_rng(3)
    factors = N._factors(2000)
    a = rng.integers(0, 1 << 63, 900, np.uint64)
    for share in (0.0, 0.5, 0.8):
        common = int(900 * share)
        b = np.concatenate([a[:common], rng.integers(0, 1 << 63, 900 - common, np.uint64)])
        packed = [np.frombuffer(N.pack(N.minima(x, factors), 2), np.uint8)[None] for x in (a, b)]
        assert abs(N.estimate(*packed, 2000, 2)[0] - common / (1800 - common)) < 0.06


def test_keep_one(spark, empty, clashing):
    out = N.keep_one(clashing)
    assert out.columns == clashing.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3]
    assert N.keep_one(empty).count() == 0
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one text in very many copies here").alias("text"))
    assert [r["doc_id"] for r in N.keep_one(many).collect()] == [0]
