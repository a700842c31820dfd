import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tillroll.llm import hmm
from tillroll.llm.hmm import Parameters, _segments, forward_backward, likelihoods, op9_hidden_markov_scores, score_texts


def random_model(states=3, symbols=5, seed=1):
    rng = np.random.default_rng(seed)
    part = lambda *shape: rng.random(shape) + 0.1
    start, move, emit = part(states), part(states, states), part(symbols, states)
    return Parameters(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0), np.full(states, 1 / states))


def by_paths(p, seq):
    """The joint probability of each path of states."""
    for path in itertools.product(range(len(p.start)), repeat=len(seq)):
        x = p.start[path[0]] * p.emit[seq[0], path[0]]
        for a, b, s in zip(path, path[1:], seq[1:]):
            x *= p.move[a, b] * p.emit[s, b]
        yield path, x


SEQS = [[0, 3, 1, 1, 4], [2], [4, 4, 0], [1, 2, 3, 0, 2, 2]]


def test_likelihood_against_all_paths():
    p = random_model()
    flat, ends = np.concatenate([np.array(s) for s in SEQS]), np.cumsum([0] + [len(s) for s in SEQS])
    for got, seq in zip(likelihoods(p, flat, ends), SEQS):
        assert got == pytest.approx(math.log10(sum(x for _, x in by_paths(p, seq))))


def test_expected_counts_against_all_paths():
    p = random_model()
    flat, ends = np.concatenate([np.array(s) for s in SEQS]), np.cumsum([0] + [len(s) for s in SEQS])
    emitted, moved, started = np.zeros(p.emit.shape), np.zeros(p.move.shape), np.zeros(3)
    forward_backward(p, flat, *_segments(ends), emitted, moved, started)
    e, m, s = np.zeros(p.emit.shape), np.zeros(p.move.shape), np.zeros(3)
    for seq in SEQS:
        paths = list(by_paths(p, seq))
        all_ = sum(x for _, x in paths)
        for path, x in paths:
            s[path[0]] += x / all_
            for a, o in zip(path, seq):
                e[o, a] += x / all_
            for a, b in zip(path, path[1:]):
                m[a, b] += x / all_
    assert np.allclose(emitted, e) and np.allclose(moved, m) and np.allclose(started, s)


def test_rounds_raise_the_likelihood():
    p = random_model(seed=7)
    flat, ends = np.concatenate([np.array(s) for s in SEQS]), np.cumsum([0] + [len(s) for s in SEQS])
    before = likelihoods(p, flat, ends).sum()
    for _ in range(5):
        emitted, moved, started = np.zeros(p.emit.shape), np.zeros(p.move.shape), np.zeros(3)
        forward_backward(p, flat, *_segments(ends), emitted, moved, started)
        p = Parameters(started / started.sum(), moved / moved.sum(1, keepdims=True), emitted / emitted.sum(0), p.usual)
        now = likelihoods(p, flat, ends).sum()
        assert now >= before - 1e-9
        before = now


def test_long_lists_are_cut_into_segments():
    begin, length, opens = _segments(np.array([0, 3, 3, 2 * hmm.SEGMENT + 4]))
    assert length.sum() == 2 * hmm.SEGMENT + 4 and opens.sum() == 2 and len(begin) == 4


def test_counts_and_base_scores(spark, sf01):
    texts = {r.doc_id: r.text.encode().lower().split() + [b"\n"] for r in
             spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 7 == 2}
    c = Counter(w for d, t in texts.items() if d not in held for w in t)
    n, v = sum(c.values()), len(c)
    rows = op9_hidden_markov_scores(spark, sf01).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) * 0.95


def test_small_table_agrees_with_large_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    few = {r.doc_id: r for r in score_texts(docs, docs["doc_id"] % 2 == 0, vocabulary=50, rounds=1).collect()}
    many = {r.doc_id: r for r in score_texts(docs, docs["doc_id"] % 2 == 0, rounds=1).collect()}
    for d, r in many.items():
        assert few[d].base_score == pytest.approx(r.base_score) and few[d].n_known == r.n_known


@pytest.mark.parametrize("count, length", [(3, 5_000), (40, 6)])
def test_states_differ_in_a_corpus_of_long_or_short_texts_only(spark, count, length):
    rng = np.random.default_rng(4)
    texts = [(rng.integers(0, 20, length) + 20 * (np.arange(length) * 4 // length + i) % 80).astype(np.int32) for i in range(count)]
    rows = [(i, True, t.tolist(), len(t)) for i, t in enumerate(texts)]
    encoded = spark.createDataFrame(rows, "row long, training boolean, symbols array<int>, n long")
    usual = (np.bincount(np.concatenate(texts), minlength=80) + 1.0) / (count * length + 80)
    p = hmm.baum_welch(encoded, usual, 4, 3)
    assert all(np.abs(p.emit[:, a] - p.emit[:, b]).sum() > 0.05 for a, b in itertools.combinations(range(4), 2))
    pieces = hmm.first_texts(encoded)
    assert sorted(np.concatenate(pieces)) == sorted(np.concatenate(texts)) and max(map(len, pieces)) <= hmm.FIRST_LONGEST
    flat, ends = np.concatenate(texts), np.arange(count + 1) * length
    assert likelihoods(p, flat, ends).sum() > np.log10(usual[flat]).sum() * (0.95 if length > 100 else 1.0)


def test_equal_texts_give_states_that_differ():
    for texts in ([], [np.arange(30)] * 20, [np.zeros(2, int)]):
        p = hmm.first_parameters(texts, np.full(40, 1 / 40), 8)
        assert np.allclose(p.emit.sum(axis=0), 1) and len(np.unique(p.emit.round(12), axis=1).T) == 8


def test_odd_rows(odd_docs, no_docs):
    got = score_texts(odd_docs, odd_docs["doc_id"] != 3, rounds=1, states=2).collect()
    assert len(got) == odd_docs.count() and all(r.score <= 0 and math.isfinite(r.score) for r in got)
    ends = {r.doc_id: r for r in got}
    assert ends[0].n_tokens == ends[1].n_tokens == ends[2].n_tokens == 1 and ends[8].n_tokens == 30_001
    none = score_texts(odd_docs, odd_docs["doc_id"] > 99).collect()
    assert all(r.score == r.base_score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in none)
    assert score_texts(no_docs, no_docs["doc_id"] > 0).count() == 0
