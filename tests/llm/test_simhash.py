import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tillroll.llm.simhash import Pivots, bands_for, close_pairs, fingerprint, keep_one, near_duplicates, op5_simhash_pivots


def brute_print(text, width=3):
    w = (text or "").encode().lower().split()
    sh = [b" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints, most=3):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    v = np.array(prints, dtype=np.uint64)
    for i in range(len(v)):
        for j in np.nonzero(np.bitwise_count(v[i] ^ v[i + 1:]) <= most)[0] + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    groups = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), []).append(x)
    return {x: min((y for y in g if y is not None), default=None) for g in groups.values() for x in g}


def test_whole_table_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in op5_simhash_pivots(spark, sf).collect()}
    prints = [brute_print(r.text) for r in docs]
    want = components([r.doc_id for r in docs], prints)
    assert len(got) == len(docs)
    for r, p in zip(docs, prints):
        assert got[r.doc_id].fingerprint == f"{p:016x}" and got[r.doc_id].component_id == want[r.doc_id]


def test_all_close_pairs_are_found_whatever_the_bands(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(40)]
    prints = {0, (1 << 64) - 1}
    for s in seeds:
        for _ in range(6):
            x = s
            for b in rng.sample(range(64), rng.randrange(6)):
                x ^= 1 << b
            prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for bands in (None, 5, 7):
        assert {(r.a, r.b) for r in close_pairs(df, "fp", 3, bands=bands).collect()} == want


def test_pivot_distances_bound_the_bits(spark):
    p = Pivots()
    row = spark.createDataFrame([(7, 5)], "a long, b long").select(
        p.distances(F.col("a")).alias("d"), p.distances(F.col("b")).alias("e")).first()
    assert max(abs(x - y) for x, y in zip(row.d, row.e)) <= 1 and len(row.d) == 49
    assert bands_for(1000, 3) == 5 < bands_for(10 ** 9, 3)


def test_odd_rows(odd_docs, no_docs):
    got = near_duplicates(odd_docs).collect()
    rows = odd_docs.collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.fingerprint % 2 ** 64) for r in got) == sorted((str(r.doc_id), brute_print(r.text)) for r in rows)
    want = components([r.doc_id for r in rows], [brute_print(r.text) for r in rows])
    assert all(r.component_id == want[r.doc_id] for r in got if r.doc_id is not None)
    assert near_duplicates(no_docs).count() == 0
    assert fingerprint("x " * 300_000) == brute_print("x " * 300)


def test_one_row_of_each_group_stays(odd_docs, no_docs):
    kept = keep_one(odd_docs).collect()
    # nulls and blanks are one group (ids 0, 1, 2 and a null id), the repeated text another (5, 5, 5, 6)
    assert sorted(str(r.doc_id) for r in kept) == ["0", "3", "4", "5", "7", "8", "None"]
    assert keep_one(odd_docs).columns == odd_docs.columns and keep_one(no_docs).count() == 0
