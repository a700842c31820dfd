import re
from collections import Counter

import duckdb
import pytest

from tillroll.llm.mixing import mix, mixed_documents, op6_water_filling_mix, oracle_sql, repeating_weights


def fill(sizes, weights, total, epochs):
    """Targets by clamping and resharing until none is above its cap."""
    capped = set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        target = {s: epochs * sizes[s] if s in capped else weights[s] * rest / w for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > epochs * sizes[s]}
        if not over:
            return target
        capped |= over


def check(rows, texts, sources):
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in texts.items()}
    per = Counter()
    for d, s in sources.items():
        per[s] += size[d]
    order = sorted(per, key=lambda s: (s is None, (s or "").encode()))
    want = fill(dict(per), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(per.values()), 2.0)
    taken = Counter()
    for r in rows:
        s = sources[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == per[s] and r.target == pytest.approx(want[s])
        assert r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] += r.taken
    return want, taken, size


def test_whole_table(spark, sf01):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    rows = op6_water_filling_mix(spark, sf01).collect()
    want, taken, size = check(rows, {d: r.text for d, r in docs.items()}, {d: r.source for d, r in docs.items()})
    assert len(rows) == len(docs)
    for s in want:  # no document that would still have fitted twice over is left out
        assert 0 <= want[s] - taken[s] <= 0.03 * want[s]
    again = op6_water_filling_mix(spark, sf01).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_whole_table_against_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = c.sql(oracle_sql()["op6_water_filling_mix"])
    got = op6_water_filling_mix(spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def hot_docs(spark):
    """A third of the rows share no id, two thirds of these also one text; other ids stand on two rows."""
    rows = [(None, "said again and again " + (f"{i} " * (i % 7) if i % 9 == 0 else ""), "a" if i % 2 else "b") if i % 3 == 0 else
            (i // 4, "w " * (i % 23), ("a", "b", None)[i % 3]) for i in range(3000)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_rows_without_an_id_are_taken_one_by_one(spark, tmp_path):
    hot_docs(spark).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    got = op6_water_filling_mix(spark, str(tmp_path)).collect()
    assert len(got) == 3000
    per = {}
    for r in mix(docs, repeating_weights(docs)).collect():
        taken, _ = per.get(r.source, (0, 0))
        per[r.source] = (taken + r.mix_size * r.mix_copies, r.mix_target)
        assert r.mix_copies <= 2
    assert all(0 <= target - taken <= 22 for taken, target in per.values())
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(oracle_sql()["op6_water_filling_mix"])
    order = lambda rows: sorted(rows, key=str)
    assert order(tuple(r[x] for x in want.columns) for r in got) == order(want.fetchall())
    again = mix(docs.repartition(5), repeating_weights(docs)).groupBy("doc_id", "text", "source", "mix_copies").count().collect()
    once = mix(docs, repeating_weights(docs)).groupBy("doc_id", "text", "source", "mix_copies").count().collect()
    assert order(map(tuple, again)) == order(map(tuple, once))


def test_odd_rows(odd_docs, no_docs):
    one = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = mix(one, repeating_weights(one)).collect()
    assert len(rows) == one.count()
    assert set(one.columns) < set(rows[0].asDict())
    totals = Counter()
    for r in rows:
        totals[r.source] += len((r.text or "").split())
    assert all(r.mix_source_size == totals[r.source] for r in rows)
    many = mixed_documents(odd_docs, repeating_weights(odd_docs))
    assert many.columns == odd_docs.columns
    assert mix(odd_docs, repeating_weights(odd_docs)).count() == odd_docs.count()
    assert mix(no_docs, repeating_weights(no_docs)).count() == 0 and mixed_documents(no_docs, repeating_weights(no_docs)).count() == 0


def test_all_sources_at_their_caps(spark):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 2}") for i in range(6)], "doc_id long, text string, source string")
    rows = mix(docs, repeating_weights(docs), fraction=3.0).collect()
    assert all(r.mix_target == 18.0 and r.mix_copies == 2 for r in rows)
