"""Operator 13: periodic runs of words by recompression.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical) of at least ``max(min_words, min_repeats * q)`` words that no neighbouring
word extends. Documents are independent, so the job is a single pass without a shuffle:
each task takes its texts in blocks of about ``BLOCK`` words and builds one run-length grammar a
block, with a separator symbol of its own before each text.

Recompression: level 0 are the words' numbers. Rounds follow in which first every block of a
repeated symbol becomes one symbol (symbol, count), then every pair whose left symbol is in one half of
the alphabet and whose right symbol is in the other (halves from a fixed mixing of the
numbers, the direction with more pairs) becomes one symbol. Neighbouring symbols that stand nowhere else
become one symbol too, for no repeat holds them. Equal symbols have equal
expansions, and equal passages get equal symbols but for a few at their edges.

LCE queries climb to a larger pair of equal symbols where both sides begin (backward: end) one,
skip equal symbols and whole blocks, and descend where symbols differ; a difference
between words ends them. All queries of a block advance together as arrays. The answers are exact.

Candidates: a run of period q covers a multiple of ``max((min_repeats - 1) * q, min_words - q)``
at which the word q further on is the same; over all q these grids have a harmonic sum of points
(n log n). At each such point the extensions to both sides give the run. Multiples of
a run's smallest period give the same stretch, whose smallest period stays.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import crc32_of_id, free_name, table, utf8

MIN_WORDS = 24
MIN_REPEATS = 3
BLOCK = 100_000
CANDIDATES = 400_000

_RUNS = T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))


def _named(left: np.ndarray, right: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
    """A number from ``fresh`` on for each distinct (left, right), and the first number that is free."""
    key, at = np.unique(left.astype(np.int64) * (int(right.max()) + 1) + right, return_inverse=True)
    return fresh + at, fresh + len(key)


def _single(symbol: np.ndarray, fresh: int) -> np.ndarray:
    """Which symbols stand nowhere else in the sequence."""
    return np.bincount(symbol, minlength=fresh)[symbol] == 1


def _half(symbol: np.ndarray, level: int) -> np.ndarray:
    """Which half of the alphabet each symbol is in at this level: one bit of a fixed mixing of its number."""
    x = symbol.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(17) & np.uint64(1)).astype(bool)


def _grouped(opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last member of each group, where ``opens`` marks the members that begin one."""
    first = np.flatnonzero(opens)
    return first, np.append(first[1:], len(opens)) - 1


class Grammar:
    """The run-length grammar of a sequence of numbers from 0, with exact extension queries.

    All levels lie behind one another in flat arrays, each between two end marks that equal nothing but themselves.
    Of every node: ``symbol``, ``width`` (words), the number of equal symbols from it on in its block
    (``ahead``) and up to it (``behind``), the parent that it begins or ends (or -1), and its first and last child (or -1).
    """

    def __init__(self, words: np.ndarray):
        symbol = words.astype(np.int32)
        fresh = int(symbol.max(initial=-1)) + 1
        width = np.ones(len(symbol), np.int32)
        parts: dict[str, list[np.ndarray]] = {k: [] for k in (
            "symbol", "width", "ahead", "behind", "begins", "ends", "first", "last")}
        at, first, last, level = 0, None, None, 0
        while True:
            n = len(symbol)
            blocks = level % 2 == 0
            alone = np.zeros(n, bool)
            if blocks:
                alone = _single(symbol, fresh)
                same = (symbol[1:] == symbol[:-1]) | (alone[1:] & alone[:-1])
            else:
                half = _half(symbol, level)
                same, down = ~half[:-1] & half[1:], half[:-1] & ~half[1:]
                if np.count_nonzero(down) > np.count_nonzero(same):
                    same = down
            opens = np.append(np.ones(min(n, 1), bool), ~same)
            done = bool(alone.all()) if blocks else False
            lo, hi = _grouped(opens)
            place = np.arange(n, dtype=np.int32)
            inner = {"symbol": symbol, "width": width, "ahead": np.ones(n, np.int32), "behind": np.ones(n, np.int32)}
            if blocks:
                group = np.cumsum(opens) - 1
                inner["ahead"] = np.where(alone, 1, hi[group] - place + 1).astype(np.int32)
                inner["behind"] = np.where(alone, 1, place - lo[group] + 1).astype(np.int32)
            above = at + n + 2
            begins, ends = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
            if not done:
                begins[lo] = ends[hi] = above + 1 + np.arange(len(lo))
            bottom = first is None
            inner |= {"begins": begins, "ends": ends, "first": begins * 0 - 1 if bottom else below + 1 + first,
                      "last": begins * 0 - 1 if bottom else below + 1 + last}
            marks = {"symbol": (-1, -2), "width": (0, 0), "ahead": (1, 1), "behind": (1, 1), "begins": (-1, -1), "ends": (-1, -1),
                     "first": (-1, -1) if bottom else (below, at - 1), "last": (-1, -1) if bottom else (below, at - 1)}
            for k, x in inner.items():
                parts[k] += [np.array(marks[k][:1], np.int32), x.astype(np.int32), np.array(marks[k][1:], np.int32)]
            if done:
                break
            new = symbol[lo]
            aside = np.flatnonzero((hi > lo) & alone[lo])
            new[aside] = fresh + np.arange(len(aside))
            fresh += len(aside)
            grown = np.flatnonzero((hi > lo) & ~alone[lo])
            if len(grown):
                new[grown], fresh = _named(symbol[lo[grown]], hi[grown] - lo[grown] if blocks else symbol[hi[grown]], fresh)
            width = np.add.reduceat(width, lo)
            below, at, first, last, symbol, level = at, above, lo, hi, new, level + 1
        for k, x in parts.items():
            setattr(self, k, np.concatenate(x))

    def _extended(self, x, y, step: int, skip, parent, child) -> np.ndarray:
        symbol, width = self.symbol, self.width
        out = np.zeros(len(x), np.int64)
        query = np.arange(len(x))
        while len(query):
            same = symbol[x] == symbol[y]
            px, py = parent[x], parent[y]
            climb = same & (px >= 0) & (py >= 0)
            climb[climb] = symbol[px[climb]] == symbol[py[climb]]
            go = same & ~climb
            many = np.minimum(skip[x], skip[y])
            out[query[go]] += many[go] * width[x[go]]
            # up where the parents are equal, on behind equal symbols, else down
            nx = np.where(climb, px, np.where(go, x + step * many, child[x]))
            ny = np.where(climb, py, np.where(go, y + step * many, child[y]))
            left = nx >= 0
            query, x, y = query[left], nx[left], ny[left]
        return out

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on (i < j)."""
        return self._extended(i + 1, j + 1, 1, self.ahead, self.begins, self.first)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j (i < j)."""
        return self._extended(i, j, -1, self.behind, self.ends, self.last)


def grid(own: np.ndarray, min_words: int, min_repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of all grid points at which the word one period on is the same.

    Short periods are taken one by one with all their points, long ones with their first, second, ... points
    at once, so that a text of n words takes about the square root of n steps.
    """
    n, times = len(own), min_repeats - 1
    most = n // min_repeats
    short = min(most, max(isqrt(n), min_words // min_repeats + 1))
    for p in range(1, short + 1):
        step = max(times * p, min_words - p)
        at = (own[:n - p:step] == own[p::step]).nonzero()[0]
        if len(at):
            yield at * step, np.full(len(at), p)
    j = 0
    while (top := min(most, (n - 1) // (times * j + 1))) > short:
        a, b = times * j, times * j + 1
        low = short + 1
        left = own[a * low:a * top + 1:a] if j else own[:1]
        p = low + (left == own[b * low:b * top + 1:b]).nonzero()[0]
        if len(p):
            yield a * p, p
        j += 1


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of rows (begin, end, period), the smallest period of each stretch, by begin and end."""
    runs = runs[np.lexsort(runs.T[::-1])]
    return runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))] if len(runs) else runs


def runs_of(texts: list[np.ndarray], min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> list[np.ndarray]:
    """The runs of each sequence of numbers from 0: rows (start, length, period) by start, then period."""
    top = max((int(x.max(initial=-1)) for x in texts), default=-1) + 1
    begin = np.cumsum([1] + [len(x) + 1 for x in texts])
    whole = np.concatenate([y for k, x in enumerate(texts) for y in ([top + k], x)] or [[]]).astype(np.int32)
    found, waiting, held = np.zeros((0, 3), np.int64), [], 0
    grammar = None

    def settle():
        nonlocal found, waiting, held, grammar
        if not waiting:
            return
        grammar = grammar or Grammar(whole)
        i, p = (np.concatenate(x) for x in zip(*waiting))
        ahead, behind = grammar.forward(i, i + p), grammar.backward(i, i + p)
        good = ahead + behind >= np.maximum((min_repeats - 1) * p, min_words - p)
        new = np.stack([(i - behind)[good], (i + p + ahead)[good], p[good]], axis=1)
        found, waiting, held = _smallest(np.concatenate([found, new])), [], 0

    for k, own in enumerate(texts):
        if len(own) >= min_words:
            for at, p in grid(own, min_words, min_repeats):
                waiting.append((begin[k] + at, p))
                held += len(at)
                if held >= CANDIDATES:
                    settle()
    settle()
    of = np.searchsorted(begin, found[:, 0], side="right") - 1
    runs = np.stack([found[:, 0] - begin[of], found[:, 1] - found[:, 0], found[:, 2]], axis=1)
    order = np.lexsort((runs[:, 2], runs[:, 0], of))
    ends = np.searchsorted(of[order], np.arange(len(texts) + 1))
    return [runs[order[a:b]] for a, b in zip(ends[:-1], ends[1:])]


def collapsed(own: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by one space, without those that stand in any run behind its first period."""
    if not len(runs):
        return b" ".join(own)
    gone = np.zeros(len(own) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    return b" ".join(own[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist())


def _blocks(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    block, held = [], 0
    for text in texts:
        own = utf8(text).split()
        if block and held + len(own) > BLOCK:
            yield block
            block, held = [], 0
        block.append(own)
        held += len(own)
    yield block


def analysed(texts: list[str | None], min_words: int = MIN_WORDS,
             min_repeats: int = MIN_REPEATS) -> Iterator[tuple[list[np.ndarray], list[bytes]]]:
    """Block by block of the texts: their runs, and their collapsed texts."""
    for block in _blocks(texts):
        numbers: defaultdict[bytes, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        coded = [np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)) for own in block]
        runs = runs_of(coded, min_words, min_repeats)
        yield runs, [collapsed(own, r) for own, r in zip(block, runs)]


def with_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS,
              runs: str = "runs", short: str = "collapsed") -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period in words, by start) and ``collapsed``.

    ``collapsed`` is the text's words joined by one space, without the words of any run behind its first
    period. Words are runs of characters other than ASCII white space. A null, empty or shorter text has no
    runs (a null text collapses to the empty text). Each row is analysed by itself: repeated rows and null ids
    need no rule. All columns are kept; the two new ones get an underscore where their names are taken.
    Texts are analysed whole; a task holds about 200 bytes a word of its longest text.
    """
    into = [free_name(docs, runs), free_name(docs, short)]
    names = [f"c{i}" for i in range(len(docs.columns))] + ["runs", "collapsed"]
    plain = docs.toDF(*names[:-2])
    at = docs.columns.index(text)
    kind = to_arrow_type(_RUNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for found, texts in analysed(batch.column(at).to_pylist(), min_words, min_repeats):
                part = batch.slice(done, len(texts))
                done += len(texts)
                flat = np.concatenate([np.zeros((0, 3), np.int64), *found])
                ends = pa.array(np.cumsum([0] + [len(r) for r in found]), pa.int32())
                entries = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(ends, entries), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=names)

    schema = T.StructType([*plain.schema.fields, T.StructField("runs", _RUNS), T.StructField("collapsed", T.StringType())])
    return plain.mapInArrow(run, schema).toDF(*docs.columns, *into)


def repeating_tail(text: Column, doc_id: Column) -> Column:
    """The query's test texts: of every tenth document by CRC-32 of the id, the words from one place on repeat a period."""
    h = crc32_of_id(doc_id)
    g = F.floor(h / 10)
    own = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    pick = F.struct(own.alias("w"), g.alias("g"))

    def tail(x: Column) -> Column:
        n = F.size(x["w"])
        a = F.pmod(x["g"], n).cast("int")
        p = (1 + F.floor((n - a) / (3 + x["g"] % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        again = F.slice(F.flatten(F.array_repeat(F.slice(x["w"], a + 1, p), times)), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(x["w"], F.lit(1), a), again), " ")).otherwise("")

    return F.when(h % 10 == 0, F.transform(F.array(pick), tail)[0]).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents; a null id counts as the empty text, a null text has no words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = with_runs(docs.select("doc_id", repeating_tail(F.col("text"), F.col("doc_id")).alias("text"))).drop("text")
    none = F.lit(None).cast(_RUNS.elementType)
    best = F.aggregate("runs", none, lambda top, r: F.when(
        top.isNull() | (r["length"] * top["period"] > top["length"] * r["period"]), r).otherwise(top))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    return (found.withColumn("best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                    F.col("best.length").alias("length"), F.col("best.period").alias("period"),
                    F.expr("1000L * best.length div best.period").alias("exponent_milli"),
                    F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
                    F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
