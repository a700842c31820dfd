import duckdb

from tillroll.llm.line_dedup import deduplicated, kept_spans, op7_line_dedup, oracle_sql, repeats, units


def test_units_have_the_offsets_of_the_original():
    text = "First line here.\nA second one, of eight or more words indeed. Then two more words! \n"
    found = list(units(text, 2))
    assert [text[s:s + n] for _, s, n, *_ in found] == [
        "First line here.", "A second one, of eight or more words indeed. Then two more words! ",
        "A second one, of eight or more words indeed. ", "Then two more words! "]
    assert list(units(None)) == list(units("")) == []


def test_whole_table_against_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = c.sql(oracle_sql()["op7_line_dedup"])
    got = op7_line_dedup(spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and got


def test_a_passage_within_other_lines_is_found(spark):
    passage = " ".join(f"This is sentence number {i} of a passage that many texts share." for i in range(6))
    docs = spark.createDataFrame([(1, f"Begin. {passage}"), (2, f"Other words first, {passage} And some more."),
                                  (3, "Nothing of the kind stands here, it is a clean text.")], "doc_id long, text string")
    got = repeats(docs).collect()
    assert {r.doc_id for r in got} == {2} and sum(r.words for r in got) >= 60
    texts = {r.doc_id: r for r in deduplicated(docs).collect()}
    assert texts[1].text == f"Begin. {passage}" and "number 3" not in texts[2].text and texts[2].text.startswith("Other words")
    original = f"Other words first, {passage} And some more."
    assert "".join(original[s.start:s.start + s.length] for s in texts[2].kept_spans) == texts[2].text


def test_spans():
    assert kept_spans("abcdef", [(1, 2), (2, 2)]) == ("aef", [(0, 1), (4, 2)])
    assert kept_spans("", []) == ("", []) and kept_spans(None, []) == (None, [])


def test_odd_rows(odd_docs, no_docs):
    got = repeats(odd_docs).collect()
    assert {(r.doc_id, r.kept_doc_id, r.unit) for r in got} == {(6, 5, "line")}
    out = deduplicated(odd_docs).collect()
    assert len(out) == odd_docs.count()
    texts = {r.doc_id: r.text for r in out if r.doc_id is not None}
    assert texts[0] is None and texts[6] == "" and texts[5].startswith("The same")
    assert repeats(no_docs).count() == 0 and deduplicated(no_docs).count() == 0


def test_rows_of_one_id_keep_their_own_text(spark):
    """Cuts belong to a row: another text of the same id, or of a null id, stays whole."""
    shared = "This line of ten words stands in several of the texts."
    alone = ["A wholly unique text that nobody repeats stands here, nowhere else at all.",
             "Patient notes that stand here only once and that must not be touched.",
             "Another closing remark of more than eight words which only this text has."]
    rows = [(1, shared), (2, shared), (2, alone[0]), (None, shared), (None, alone[1]), (None, shared + "\n" + alone[2])] + [(None, shared)] * 30
    got = deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    texts = [(r.doc_id, r.text) for r in got]
    assert (1, shared) in texts and (2, "") in texts and (2, alone[0]) in texts and (None, alone[1]) in texts
    assert (None, "\n" + alone[2]) in texts and sum(shared in t for _, t in texts) == 1
    for r in got:
        assert sum(s.length for s in r.kept_spans) == len(r.text)
