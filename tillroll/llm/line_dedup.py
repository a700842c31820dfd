"""Operator 7: substring deduplication by line hashing.

Units are the lines of every text and, within a line, its sentences (a passage
may stand in the middle of another line). Units of ``MIN_WORDS`` words or more are
normalised (lower case, runs of white space as one space) and hashed to 128 bits.
Over all texts, a digest's first occurrence by (id, offset) stays, and every other
one is removed. Results keep the offsets in the original text.

Texts are not shuffled to find the repeats, only digests with ids and offsets.
Counts and first ids are combined before the shuffle, so a line that a third of
all texts holds is a row a task; the join that brings a digest's first occurrence to the
others is an equi-join with one row a digest on one side, whose hot keys AQE splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, free_name, numbered, table

MIN_WORDS = 8
NO_ID = 2 ** 63 - 1
_END = re.compile("[.!?]+[ \t\r\x0b\x0c]+")
_FIELDS = (("doc", pa.int64()), ("line", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("words", pa.int32()),
           ("sentence", pa.bool_()), ("d1", pa.int64()), ("d2", pa.int64()))


def pieces(line: str) -> Iterator[tuple[int, str]]:
    """The sentences of a line with their offsets; their trailing space belongs to them."""
    at = 0
    for m in _END.finditer(line):
        yield at, line[at:m.end()]
        at = m.end()
    if at < len(line):
        yield at, line[at:]


def units(text: str | None, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, int, int, bool, bytes]]:
    """(offset of the line, offset, length, words, is a sentence, digest) of a text's lines and of the sentences within lines."""
    at = 0
    for line in (text or "").split("\n"):
        parts = list(pieces(line))
        for start, part in [(0, line)] + (parts if len(parts) > 1 else []):
            own = part.lower().encode("utf-8", "replace").split()
            if len(own) >= min_words:
                yield at, at + start, len(part), len(own), part is not line, xxhash.xxh3_128_digest(b" ".join(own))
        at += len(line) + 1


def _unit_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0), batch.column(1)):
                doc = doc.as_py()
                for line, start, length, n, sentence, digest in units(text.as_py(), min_words):
                    rows.append((doc, line, start, length, n, sentence, int.from_bytes(digest[:8], "big", signed=True),
                                 int.from_bytes(digest[8:], "big", signed=True)))
                if len(rows) >= 50_000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)],
                                      names=[n for n, _ in _FIELDS])


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per removed unit: (doc_id, start, length, words, unit, kept_doc_id, kept_start).

    ``start`` and ``length`` are in characters of the original text; ``unit`` is
    'line' or 'sentence' (a sentence of a removed line is not listed again); the kept
    columns name the first occurrence of a unit with the same words. Ids are ranked ascending, null last. Rows
    of one id (or of null id) count as one document: their equal units at equal
    offsets are one occurrence. Null and empty texts have no units; an empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID)).alias("doc"), docs[text].alias("text"))
    found = checkpointed(rows.mapInArrow(
        _unit_rows(min_words), "doc long, line long, start long, length long, words int, sentence boolean, d1 long, d2 long"), "units")
    digest = ["d1", "d2"]
    many = (found.groupBy(*digest).agg(F.min("doc").alias("first_doc"), F.count("*").alias("n"))
            .where("n > 1").select(*digest, "first_doc"))
    again = checkpointed(found.join(many, digest), "repeated-units")
    first = (again.where("doc = first_doc").groupBy(*digest).agg(F.min("start").alias("first_start")))
    out = (again.join(first, digest).where((F.col("doc") != F.col("first_doc")) | (F.col("start") != F.col("first_start")))
           .select("doc", "line", "start", "length", "words", "sentence", "first_doc", "first_start").distinct())
    out = checkpointed(out, "removed-units")
    lines = out.where("not sentence")
    part = out.where("sentence").join(lines.select("doc", "line"), ["doc", "line"], "left_anti").select(*out.columns)
    own_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return lines.unionByName(part).select(
        own_id("doc").alias("doc_id"), "start", "length", "words",
        F.when(F.col("sentence"), "sentence").otherwise("line").alias("unit"), own_id("first_doc").alias("kept_doc_id"),
        F.col("first_start").alias("kept_start"))


def kept_spans(text: str | None, removed) -> tuple[str | None, list[tuple[int, int]]]:
    """The text without the removed (start, length) spans, and the (start, length) of what is left of it."""
    if text is None:
        return None, []
    spans, at = [], 0
    for start, length in sorted(removed):
        if start > at:
            spans.append((at, start - at))
        at = max(at, start + length)
    if at < len(text):
        spans.append((at, len(text) - at))
    return "".join(text[a:a + n] for a, n in spans), spans


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the repeated units cut out of ``text``, and ``kept_spans``: where the rest lay in the original.

    Rows are told apart by a number of their own, in the order of their ids (null last), so that rows of one id, or
    without one, lose only their own repeats: a later copy of a row loses its units, the first row keeps them.
    """
    spans = free_name(docs, "kept_spans")
    names = [f"c{i}" for i in range(len(docs.columns))]
    own_id, own_text = (names[docs.columns.index(c)] for c in (doc_id, text))
    rows = checkpointed(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "rows")
    rank = numbered(rows.select(own_id, "row"), [F.col(own_id).asc_nulls_last(), F.col("row").asc()], "rank").select("row", "rank")
    ranked = checkpointed(rows.join(rank, "row"), "ranked-rows")
    gone = (repeats(ranked, "rank", own_text, min_words).groupBy(F.col("doc_id").alias("rank"))
            .agg(F.collect_list(F.struct("start", "length")).alias("cut")))

    @F.pandas_udf("struct<text string, spans array<struct<start: long, length: long>>>")
    def remove(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
        pairs = [kept_spans(t, [] if c is None else [(x["start"], x["length"]) for x in c]) for t, c in zip(texts, cuts)]
        return pd.DataFrame({"text": [t for t, _ in pairs],
                             "spans": [[{"start": a, "length": n} for a, n in s] for _, s in pairs]})

    cut = ranked.join(gone, "rank", "left").withColumn("cut", remove(own_text, "cut"))
    return cut.select(*[F.col("cut.text") if c == own_text else F.col(c) for c in names], "cut.spans").toDF(*docs.columns, spans)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


def oracle_sql() -> dict[str, str]:
    space = r"[ \t\r\x0b\x0c]+"
    return {"op7_line_dedup": f"""
with line as (
  select doc_id, i, l, sum(length(l) + 1) over (partition by doc_id order by i rows unbounded preceding) - length(l) - 1 as pos
  from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i
        from documents)),
part as (
  select doc_id, pos, i, p, j, sum(length(p)) over (partition by doc_id, i order by j rows unbounded preceding) - length(p) as within,
         count(*) over (partition by doc_id, i) as parts
  from (select doc_id, pos, i, unnest(x) as p, generate_subscripts(x, 1) as j
        from (select *, regexp_extract_all(l, '.*?[.!?]+{space}|.+$') as x from line))),
unit as (
  select doc_id, pos as start, length(l) as length, l as body, false as sentence from line
  union all select doc_id, pos + within, length(p), p, true from part where parts > 1),
norm as (
  select doc_id, start, length, sentence, trim(regexp_replace(lower(body), '{space}', ' ', 'g')) as body from unit),
sized as (select *, len(string_split(body, ' ')) as words from norm where body <> ''),
ranked as (
  select *, first_value(doc_id) over w as kept_doc_id, first_value(start) over w as kept_start
  from sized where words >= {MIN_WORDS} window w as (partition by body order by doc_id, start)),
gone as (
  select distinct doc_id, start, length, words, sentence, kept_doc_id, kept_start from ranked
  where doc_id <> kept_doc_id or start <> kept_start)
select doc_id, cast(start as bigint) as start, cast(length as bigint) as length, cast(words as integer) as words,
       case when sentence then 'sentence' else 'line' end as unit, kept_doc_id, cast(kept_start as bigint) as kept_start
from gone g
where not sentence or not exists (
  select 1 from gone l where not l.sentence and l.doc_id = g.doc_id and g.start >= l.start and g.start < l.start + l.length)"""}
