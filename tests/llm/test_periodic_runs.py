import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tillroll.llm.periodic_runs import Grammar, op13_periodic_runs, runs_of, with_runs


def brute_runs(own, least=24, repeats=3):
    """Every maximal stretch of every period, smallest periods first."""
    n, found = len(own), {}
    for p in range(1, n // repeats + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and own[j] == own[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, repeats * p):
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def brute_row(doc_id, text):
    own = (text or "").encode().split()
    n, h = len(own), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [w if i < a else own[a + (i - a) % p] for i, w in enumerate(own)]
    runs = brute_runs(own)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{k},{p}\n" for s, k, p in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(own) if i not in gone)))


def made(rng, n, letters):
    """A sequence with nested repeats: pieces are copied and repeated."""
    own = [rng.randrange(letters) for _ in range(max(1, n // 8))]
    while len(own) < n:
        a, k = rng.randrange(len(own)), rng.randrange(1, 40)
        own += own[a:a + k] * rng.randrange(1, 9)
        own += [rng.randrange(letters) for _ in range(rng.randrange(3))]
    return np.array(own[:n])


def test_runs_against_brute_force():
    rng = random.Random(13)
    texts = [made(rng, rng.randrange(1, 400), rng.choice([1, 2, 3, 9])) for _ in range(150)]
    texts += [np.zeros(0, int), np.zeros(1000, int), np.arange(500), np.array([0, 1] * 700), np.array(([0] * 30 + [1]) * 20)]
    assert [[tuple(r) for r in x.tolist()] for x in runs_of(texts)] == [brute_runs(x.tolist()) for x in texts]
    assert [[tuple(r) for r in x.tolist()] for x in runs_of(texts, 5, 2)] == [brute_runs(x.tolist(), 5, 2) for x in texts]


def test_candidates_settled_in_parts(monkeypatch):
    monkeypatch.setattr("tillroll.llm.periodic_runs.CANDIDATES", 7)
    rng = random.Random(1)
    texts = [made(rng, 300, 2) for _ in range(10)]
    assert [[tuple(r) for r in x.tolist()] for x in runs_of(texts)] == [brute_runs(x.tolist()) for x in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=2, max_size=120), st.randoms())
def test_extensions(own, rng):
    g, n = Grammar(np.array(own)), len(own)
    pairs = [sorted(rng.sample(range(n), 2)) for _ in range(30)]
    i, j = np.array(pairs).T
    ahead = [next((k for k in range(n - y) if own[x + k] != own[y + k]), n - y) for x, y in pairs]
    behind = [next((k for k in range(x) if own[x - 1 - k] != own[y - 1 - k]), x) for x, y in pairs]
    assert g.forward(i, j).tolist() == ahead and g.backward(i, j).tolist() == behind


def test_a_repeated_word_takes_few_steps():
    g = Grammar(np.zeros(100_000, int))
    assert g.forward(np.array([0, 7]), np.array([50_000, 99_999])).tolist() == [50_000, 1]
    assert len(g.symbol) < 210_000


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = op13_periodic_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = sorted(map(tuple, got.collect()))
    assert [r[0] for r in rows] == sorted(r.doc_id for r in docs)
    want = {r.doc_id: brute_row(r.doc_id, r.text) for r in docs if len(r.text.split()) < 3000}
    assert len(want) > 150 and all(want.get(r[0], r) == r for r in rows) and any(r[1] for r in rows)


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_periodic_runs(spark, str(tmp_path)).collect()
    short = [(r.doc_id, r.text) for r in odd_docs.collect() if r.text is None or len(r.text) < 9999]
    assert sorted(map(repr, (tuple(r) for r in got if r.period != 1))) == sorted(repr(brute_row(*r)) for r in short)
    one = next(r for r in got if r.period == 1)
    assert (one.n_runs, one.start, one.length, one.exponent_milli) == (1, 0, 30_000, 30_000_000)
    assert one.collapsed_sha256 == hashlib.sha256(b"long").hexdigest()
    named = odd_docs.withColumnRenamed("lang", "runs").withColumnRenamed("source", "Collapsed")
    out = with_runs(named)
    assert out.columns == [*named.columns, "runs_", "collapsed_"] and out.count() == odd_docs.count()
    assert with_runs(no_docs).count() == 0
