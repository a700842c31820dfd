import zlib

import pytest

from tillroll.llm import toxicity as T8
from tillroll.llm.toxicity import Model, op8_kneser_ney_toxicity, toxicity, without_toxic


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").collect()}
    rows = op8_kneser_ney_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0.0 <= r.score <= 1.0 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert sum(p for p, t in held if t) / sum(t for _, t in held) > 0.85


def test_length_does_not_decide():
    m = Model({"bad": 5.0}, other=-0.1, threshold=0.1, scale=0.1)
    assert m.score("bad " + "word " * 9) == pytest.approx(m.score(("bad " + "word " * 9) * 50))
    assert m.score("word") == m.score("word " * 1000) < 0.5 < m.score("a bad word")
    assert m.score(None) == m.score("") == m.score("word")


def test_odd_rows_and_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (5, None), (None, 1), (6, 1), (8, 0)], "doc_id long, toxic int")
    for some in (labels, labels.where("false"), labels.where("toxic = 0")):
        got = toxicity(odd_docs, some, into=("toxic_score", "predicted")).collect()
        assert len(got) == odd_docs.count() and all(0 <= r.toxic_score <= 1 for r in got)
        assert without_toxic(odd_docs, some).columns == odd_docs.columns
    assert toxicity(no_docs, labels, into=("toxic_score", "predicted")).count() == 0
    assert without_toxic(odd_docs, labels.where("false")).count() == odd_docs.count()


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    """One labelled id on many rows takes no more of the sample than the bound, and the same rows on every run."""
    monkeypatch.setattr(T8, "TOXIC_ROWS", 20)
    monkeypatch.setattr(T8, "ORDINARY_ROWS", 30)
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    docs = spark.createDataFrame([(i, f"text {n}") for n in range(500) for i in (ids[0], ids[1])] + [(i, "once") for i in ids[2:]],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(ids[0], 1), (ids[1], 0)] + [(i, i % 2) for i in ids[2:]], "doc_id long, toxic int")
    got = T8.sample(docs, labels, "doc_id", "text")
    assert {r.toxic: r["count"] for r in got.groupBy("toxic").count().collect()} == {1: 20, 0: 30}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, T8.sample(docs.repartition(3), labels, "doc_id", "text").collect()))


def test_a_score_column_of_the_documents_stays(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    got = toxicity(odd_docs, labels)
    assert got.columns == [*odd_docs.columns, "score_", "predicted"]
    own = lambda df: sorted((r.doc_id is None, r.doc_id or 0, r.score or -1) for r in df.collect())
    assert own(got) == own(odd_docs)
