import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tillroll.llm import packing
from tillroll.llm.packing import (Encoder, configurations, cut, grouped, op11_best_fit_packing, packed, packing_plan,
                                  sequences)

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("stretch", [1_000_000, 7])
def test_ids_are_those_of_the_tokenizer(tokenizer, monkeypatch, stretch):
    monkeypatch.setattr(packing, "_STRETCH", stretch)
    rng = random.Random(3)
    some = [" ", "\n", "\t", "a", "b", "é", "s", "'", "t", ",", ".", "!", "5", " ", "　", "日", "$", "-", "\r", "\x1f", "\x85",
            "​", " ", "²", "½", "\x1c", "\x00", "д", "ｱ", "🙂", "é", " the", " tion", "'ll", " 123"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["", " ", "<|endoftext|> x a<|endoftext|>", "x" * 20_000, " " * 5000 + "a", "aé" * 3000]
    encoded = Encoder(PATH)
    assert [np.frombuffer(encoded(t), "<u4").tolist() for t in texts] == [
        tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_of_other_kinds_go_to_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoded = Encoder(path)
    assert encoded.fast is None
    assert np.frombuffer(encoded("Some words"), "<u4").tolist() == Tokenizer.from_file(path).encode("Some words", add_special_tokens=False).ids


def test_cuts():
    assert cut(5, 8) == [(0, 5)] and cut(8, 8) == [(0, 8)] and cut(19, 8) == [(0, 3), (3, 8), (11, 8)] and cut(16, 8) == [(0, 8), (8, 8)]


def layout(plan, counts, capacity):
    """Every sequence's (offset, length), after a check that each piece of each length has one place."""
    own, seen = {}, Counter()
    for p in plan:
        seen[p.length] += p.count
        for k in range(p.count):
            own.setdefault(p.sequence + k // p.each, []).append((p.offset + k % p.each * p.length, p.length))
    assert seen == Counter({n: c for n, c in counts.items() if c})
    for n in counts:
        spans = sorted((p.first, p.count) for p in plan if p.length == n)
        assert [a for a, _ in spans] == [sum(c for _, c in spans[:i]) for i in range(len(spans))]
    for s in own.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= capacity
    assert sorted(own) == list(range(len(own)))
    return own


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=30))
def test_plans_hold_every_piece_once(counts):
    own = layout(packing_plan(counts, 64, 8), counts, 64)
    total = sum(n * c for n, c in counts.items())
    large = sum(c for n, c in counts.items() if n > 32)
    assert len(own) >= max(-(-total // 64), large)
    assert len(own) <= 1.7 * max(total / 64, large) + 2


def test_plans_are_near_the_bound_and_small():
    rng = np.random.default_rng(11)
    lengths = np.minimum(2048, np.exp(rng.normal(5.8, 1.0, 20_000)).astype(int) + 1)
    counts = {n: int(c) for n, c in enumerate(np.bincount(lengths)) if c}
    total = int(lengths.sum())
    assert len(layout(packing_plan(counts), counts, 2048)) <= 1.02 * total / 2048
    many = {n: c * 1_000_000 for n, c in counts.items()}
    plan = packing_plan(many)
    assert len(plan) < 20_000 and max(p.sequence + -(-p.count // p.each) for p in plan) <= 1.02 * total / 2048 * 1_000_000


def test_groups_and_configurations():
    assert grouped({9: 3, 8: 2, 5: 3, 2: 50}, 2, 4) == [(9, [[9, 2], [9, 1], [8, 1]]), (8, [[8, 1], [5, 1]]), (5, [[5, 2]])]
    # sixths, thirds and halves of the capacity: the optimum of the linear program is the volume bound
    found = configurations([6, 4, 2], [100, 100, 100], 12)
    assert abs(sum(x for _, x in found) - 100) < 1e-6
    assert all(sum(n * c for n, c in zip((6, 4, 2), config)) <= 12 for config, _ in found)


def test_whole_table(spark, sf, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op11_best_fit_packing(spark, sf).collect()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    assert set(of) == set(docs)
    total = 0
    for doc, own in of.items():
        ids = np.array(tokenizer.encode(docs[doc], add_special_tokens=False).ids + [0], "<u4")
        own.sort(key=lambda r: r.piece)
        total += len(ids)
        assert [(r.piece, r.start, r.length) for r in own] == [(i, a, n) for i, (a, n) in enumerate(cut(len(ids), 2048))]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in own)
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in fill.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:i]) for i in range(len(s))] and sum(n for _, n in s) <= 2048
    assert len(fill) <= 1.1 * total / 2048


def test_odd_rows_and_sequences(spark, odd_docs, no_docs, tokenizer):
    rows = packed(odd_docs, PATH, capacity=64).collect()
    assert sum(r.piece == 0 for r in rows) == odd_docs.count()
    assert sum(r.length == 1 for r in rows if r.doc_id in (0, 1)) == 2
    assert packed(no_docs, PATH).collect() == [] and sequences(no_docs, PATH).collect() == []
    texts = [r.text for r in odd_docs.collect()]
    want = Counter(tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for t in texts if len(t or "") < 9999)
    docs = odd_docs.withColumn("sequence_id", odd_docs.score).withColumn("piece", odd_docs.lang)
    got = Counter()
    for s in sequences(docs, PATH).collect():
        assert len(s.ids) <= 2048
        got.update(tuple(s.ids[p.offset:p.offset + p.length]) for p in s.pieces)
    assert not want - got


def test_copies_of_one_text_without_ids(spark):
    docs = spark.createDataFrame([(None, "the same words")] * 3000, "doc_id long, text string").repartition(3)
    rows = packed(docs, PATH).collect()
    assert len(rows) == 3000 and len({(r.sequence_id, r.offset) for r in rows}) == 3000
    assert len({r.sequence_id for r in rows}) == -(-3000 // (2048 // rows[0].length))
