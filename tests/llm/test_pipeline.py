"""The stages against brute force, and the guard that lets the rest of the library do without them."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline as P
from tillroll.llm import queries as Q
from tillroll.llm.common import numbered
from tillroll.llm.components import connected_components

from .test_decontaminate import brute as brute_overlaps
from .test_simhash import brute_print, components


def test_names_and_order():
    names = sorted(Q.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert [n for n, _ in P.STAGES] == ["toxicity", "near duplicates", "benchmark decontamination", "mixing to target weights", "sharding"]


def test_stages_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = P.reject_toxic(spark, docs, sf)
    assert kept.columns == columns and 0.8 * docs.count() <= kept.count() <= docs.count()
    one = P.drop_near_duplicates(spark, docs, sf)
    rows = docs.orderBy("doc_id").collect()
    groups = components([r.doc_id for r in rows], [brute_print(r.text) for r in rows])
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(groups.values())) and one.columns == columns
    clean = P.decontaminated(spark, docs, sf)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute_overlaps([(r.doc_id, r.text) for r in rows], items)}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows} - bad and clean.columns == columns
    mixed = P.mixed(spark, docs, sf)
    words = sum(len(r.text.split()) for r in rows)
    assert mixed.columns == columns
    assert 1.4 * words < sum(len(r.text.split()) for r in mixed.collect()) <= 1.5 * words
    assert P.sharded(spark, mixed, sf).count() == mixed.count()


def test_odd_rows_through_all_stages(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs.drop("score", "fingerprint"), no_docs.drop("score", "fingerprint")):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, sf)
        docs.collect()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 100)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.vertex: r.component for r in connected_components(df, "a", "b").collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 200: 100}
    assert connected_components(df.where("false"), "a", "b").count() == 0


def test_numbers_are_gapless(spark):
    df = spark.createDataFrame([(i * 7 % 101, "x") for i in range(101)] + [(None, "y")], "k long, v string")
    got = sorted(((r.n, r.k) for r in numbered(df, ["k"], "n").collect()))
    assert got == [(0, None)] + [(i + 1, i) for i in range(101)]


def test_entry_works_without_the_subpackage():
    root = Path(__file__).parents[2]
    code = ("import sys, importlib.abc\n"
            "class No(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path, target=None):\n"
            "        if name.startswith(('tillroll.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name)\n"
            "sys.meta_path.insert(0, No())\n"
            "import __spark_entry__ as e\n"
            "q, o = e.queries(), e.oracle_sql()\n"
            "assert 'weekly_summary' in q and not any(n.startswith('op1') for n in q) and 'pipeline' not in q and set(o) <= set(q)\n")
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=300).returncode == 0
