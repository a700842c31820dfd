import itertools
import random
import re

import duckdb

from tillroll.llm.decontaminate import (AGREE, CHUNK, MASKS, WINDOW, clean_documents, op3_spaced_seed_decontamination,
                                        oracle_sql, overlaps)


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, every=False):
    """All (document, item) with a window that agrees in enough places: along every diagonal, or along those on which
    four neighbouring words are equal (two changes leave four neighbours of 13 unchanged)."""
    places = {}
    items = [(i, tokens(b)) for i, b in items]
    for n, (_, b) in enumerate(items):
        for k in range(len(b) - 3):
            places.setdefault(tuple(b[k:k + 4]), []).append((n, k))
    out = set()
    for d, t in docs:
        w = tokens(t)
        near = {(n, j - k) for j in range(len(w) - 3) for n, k in places.get(tuple(w[j:j + 4]), ())}
        if every:
            near = {(n, x) for n, (_, b) in enumerate(items) for x in range(-len(b), len(w))}
        for n, delta in near:
            i, b = items[n]
            if len(b) < 5:
                continue
            window, need = (WINDOW, AGREE) if len(b) >= WINDOW else (len(b), len(b))
            same = [0 <= k + delta < len(w) and w[k + delta] == x for k, x in enumerate(b)]
            if any(sum(same[k:k + window]) >= need for k in range(len(b) - window + 1)):
                out.add((d, i))
    return out


def test_masks_are_lossless():
    for changed in itertools.combinations(range(WINDOW), WINDOW - AGREE):
        assert any(all(at + i not in changed for i, x in enumerate(m) if x == "1")
                   for m in MASKS for at in range(WINDOW - len(m) + 1))


def test_planted_overlaps_with_substitutions(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([4, 6, 9, 13, 20, 30])))) for i in range(25)]
    docs = []
    for d in range(40):
        w = rng.choices(vocabulary, k=rng.choice([3, 12, 40, CHUNK + 30]))
        if d % 2:
            passage = tokens(rng.choice(items)[1])
            for _ in range(rng.choice([0, 1, 2, 3])):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.choice([0, len(w), rng.randrange(len(w) + 1)])
            w[at:at] = passage
        docs.append((d, ", ".join(w).upper() if d % 3 else ". ".join(w)))
    got = overlaps(spark.createDataFrame(docs, "doc_id long, text string"),
                   spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items, every=True) and len(got) > 10


def test_test_tables_against_brute_force(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in overlaps(docs, items).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    bad = {d for d, _ in got}
    assert {r.doc_id for r in clean_documents(docs, items).collect()} == {r.doc_id for r in docs.collect()} - bad


def test_whole_rows_against_sql(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = c.sql(oracle_sql()["op3_spaced_seed_decontamination"])
    got = op3_spaced_seed_decontamination(spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and got


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(3, None), (4, ""), (None, "the same text said again and again by all of them here"),
                                   (7, "the same text, said again and again by all of them here"), (8, "one two")],
                                  "item_id long, text string")
    got = overlaps(odd_docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(5, 7), (6, 7)}
    assert clean_documents(odd_docs, items).count() == odd_docs.count() - 4
    assert clean_documents(odd_docs, items).columns == odd_docs.columns
    assert overlaps(no_docs, items).count() == 0 and overlaps(odd_docs, items.where("false")).count() == 0
