"""Operator 9: a hidden Markov language model of the corpus.

Words are counted over all training texts. The ``VOCABULARY`` most frequent words
are symbols of their own (a bounded table, sent to every task); each other word
is a symbol for its ending's class and then one word of that class:
p(word | class) = (c + 1) / (C + V + 1) with C words, V distinct, in training, so that words
outside training have the weight of one. An end symbol closes every text.

Baum-Welch trains ``STATES`` latent states. They begin as the groups of at most ``FIRST_TEXTS``
pieces of training texts of any length (a longer text is cut every ``FIRST_LONGEST`` symbols; pieces under
``FIRST_SHORTEST`` come only where the others are too few), with a small seeded
disturbance, since Baum-Welch never parts states that are equal. In each round every partition of the
training texts runs the scaled forward-backward recursion, in segments of
``SEGMENT`` symbols, with the same parameters and gives its expected counts; Spark
adds them up by symbol, and the new parameters follow from the sums. Only these tables
(symbols x states) reach the driver; nothing there grows with the corpus.

Scoring runs the scaled forward recursion over each whole text, which gives the
exact likelihood of its symbols, and adds the words' share of their classes. The counts of
the words outside the table come from a join with the counts of the whole corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, crc32_of_id, table, utf8

VOCABULARY = 131_072
LONGEST = 64
CLASSES = 256
STATES = 8
ROUNDS = 3
SEGMENT = 512
FIRST_TEXTS = 512
FIRST_SHORTEST, FIRST_LONGEST = 20, 2_000
DISTURBANCE = 0.05
FOLDS, HELD = 7, 2
END = b"\n"
_FLUSH = 400_000
_SOME = 200_000


def words(text: str | None) -> list[bytes]:
    """Runs of non-white-space, A-Z lower-cased, then the end."""
    own = utf8(text).lower().split()
    own.append(END)
    return own


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                         names=["word", "c"])
        seen.clear()
        return out

    for batch in batches:
        for text in batch.column(0):
            seen.update(words(text.as_py()))
            if len(seen) >= _FLUSH:
                yield flush()
    yield flush()


def _encoder(shared):
    """Rows (id, training, text) as (id, training, symbols, base, n, rare words).

    ``shared``: the frequent words' numbers and their terms of the base score; the classes' numbers follow.
    """
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, terms = shared.value
        get, first = number.get, len(number)
        names = ["id", "training", "symbols", "base", "n", "rare"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                symbols, base, sizes, rare = [], [], [], []
                for text in part.column(2):
                    own = words(text.as_py())
                    ids = [get(w, -1) for w in own]
                    coded = np.array(ids, dtype=np.int32)
                    out = np.flatnonzero(coded < 0)
                    base.append(float(terms[coded[coded >= 0]].sum()))
                    few = [own[i] for i in out.tolist()]
                    coded[out] = [first + ending(w) for w in few]
                    symbols.append(coded)
                    sizes.append(len(own))
                    rare.append(few)
                ends = np.cumsum([0] + [len(x) for x in symbols]).astype(np.int32)
                flat = pa.array(np.concatenate(symbols) if symbols else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), flat),
                     pa.array(base, pa.float64()), pa.array(sizes, pa.int64()), pa.array(rare, pa.list_(pa.binary()))],
                    names=names)
    return encode


class Parameters(NamedTuple):
    """Start, transition (states x states) and emission (symbols x states) probabilities; the usual shares of states."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    usual: np.ndarray


def smoothed(counts: np.ndarray, prior: np.ndarray, strength: float = 50.0) -> np.ndarray:
    """Columns of expected counts as probabilities, drawn towards ``prior``, which is positive everywhere."""
    return (counts + strength * prior[:, None]) / (counts.sum(axis=0) + strength)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the ends of its lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), ends - ends[0]


def forward_backward(p: Parameters, flat: np.ndarray, begin: np.ndarray, length: np.ndarray, opens: np.ndarray,
                     emitted: np.ndarray, moved: np.ndarray, started: np.ndarray) -> None:
    """Add the expected counts of the sequences ``flat[begin:begin + length]`` to the three tables.

    Sequences that open a text begin with ``start``, the others with the usual shares of the
    states. All of them advance together, one symbol at a step, each step scaled to sum 1.
    """
    order = np.argsort(-length, kind="stable")
    begin, length, opens = begin[order], length[order], opens[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")
    ahead, scales, places = [], [], []
    a = np.where(opens[:, None], p.start[None, :], p.usual[None, :])
    for t in range(steps):
        n = active[t]
        place = begin[:n] + t
        a = (a[:n] @ p.move if t else a[:n]) * p.emit[flat[place]]
        scale = a.sum(axis=1)
        a = a / scale[:, None]
        ahead.append(a)
        scales.append(scale)
        places.append(place)
    back = np.ones((0, p.move.shape[0]))
    for t in range(steps - 1, -1, -1):
        n = active[t]
        if len(back) < n:
            back = np.vstack([back, np.ones((n - len(back), p.move.shape[0]))])
        weight = ahead[t] * back
        if t == 0:
            started += weight[opens[:n]].sum(axis=0)
        place = flat[places[t]]
        ahead[t] = weight
        if t:
            right = p.emit[place] * back / scales[t][:, None]
            moved += p.move * (ahead[t - 1][:n].T @ right)
            back = right @ p.move.T
    symbols = np.concatenate([flat[x] for x in places]) if places else np.zeros(0, np.int64)
    weights = np.concatenate(ahead) if ahead else np.zeros((0, p.move.shape[0]))
    for k in range(p.move.shape[0]):
        emitted[:, k] += np.bincount(symbols, weights[:, k], minlength=len(emitted))


def _segments(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists cut into segments: their begins, lengths, and whether they open a list."""
    begin, length, opens = [], [], []
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
        for at in range(lo, hi, SEGMENT):
            begin.append(at)
            length.append(min(SEGMENT, hi - at))
            opens.append(at == lo)
    return np.array(begin, np.int64), np.array(length, np.int64), np.array(opens, bool)


def _expecter(shared, states: int):
    """Partitions of symbol lists as expected counts: (symbol, by state); -1 - i: moves from i; -1 - states: starts."""
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Parameters(*shared.value)
        emitted, moved, started = np.zeros(p.emit.shape), np.zeros(p.move.shape), np.zeros(states)
        for batch in batches:
            flat, ends = _flat(batch.column(0))
            begin, length, opens = _segments(ends)
            if not len(begin):
                continue
            cut = np.flatnonzero(np.diff(np.concatenate([[-1], np.cumsum(length) // _SOME])))
            for lo, hi in zip(cut, [*cut[1:], len(begin)]):
                forward_backward(p, flat, begin[lo:hi], length[lo:hi], opens[lo:hi], emitted, moved, started)
        seen = np.flatnonzero(emitted.any(axis=1))
        keys = np.concatenate([seen, -1 - np.arange(states + 1)]).astype(np.int32)
        table_ = np.vstack([emitted[seen], moved, started[None, :]])
        yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(table_[:, k]) for k in range(states)]],
                                         names=["symbol", *[f"s{k}" for k in range(states)]])
    return expect


def first_parameters(texts: list[np.ndarray], usual: np.ndarray, states: int) -> Parameters:
    """States from a small sample: texts in groups of like symbols (k-means from far-apart texts), no two of them equal.

    Fewer texts than states are put together and cut into as many parts.
    """
    size = len(usual)
    emit = np.tile(usual[:, None], (1, states))
    if texts and len(texts) < states:
        texts = np.array_split(np.concatenate(texts), states)
    if texts:
        frequent = np.argsort(-usual)[:4_096]
        at = np.full(size, -1)
        at[frequent] = np.arange(len(frequent))
        x = np.zeros((len(texts), len(frequent)), np.float32)
        for i, t in enumerate(texts):
            near = at[t]
            x[i] = np.bincount(near[near >= 0], minlength=len(frequent))
        x = np.sqrt(x)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        centres = x[:1]
        while len(centres) < states:
            centres = np.vstack([centres, x[(x @ centres.T).max(axis=1).argmin()]])
        for _ in range(10):
            group = (x @ centres.T).argmax(axis=1)
            centres = np.vstack([x[group == k].sum(axis=0) if (group == k).any() else centres[k] for k in range(states)])
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
        counts = np.zeros((size, states))
        for k in range(states):
            own = [t for t, g in zip(texts, group) if g == k]
            if own:
                counts[:, k] = np.bincount(np.concatenate(own), minlength=size)
        emit = smoothed(counts, usual)
    if states > 1:
        emit = emit * (1 + DISTURBANCE * np.random.default_rng(9).random(emit.shape))
        emit /= emit.sum(axis=0)
    stay = 0.95
    move = np.full((states, states), (1 - stay) / max(states - 1, 1))
    np.fill_diagonal(move, stay if states > 1 else 1.0)
    even = np.full(states, 1.0 / states)
    return Parameters(even, move, emit, even)


def first_texts(training: DataFrame) -> list[np.ndarray]:
    """The pieces of ``training`` (row, n, symbols) for the first states, in the order of a hash; long enough ones first."""
    size = F.least(F.lit(FIRST_LONGEST), F.col("n") - F.col("at"))
    places = training.select("row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(FIRST_LONGEST).cast("long")))
                             .alias("at"))
    chosen = (places.select("row", "at", size.alias("size"))
              .orderBy(F.col("size") < FIRST_SHORTEST, F.xxhash64("row", "at"), "row", "at").limit(FIRST_TEXTS).collect())
    if not chosen:
        return []
    spark = training.sparkSession
    wanted = spark.createDataFrame([(r.row, r.at, r["size"]) for r in chosen], "row long, at long, size long")
    found = (training.where(F.col("row").isin([r.row for r in chosen])).join(F.broadcast(wanted), "row")
             .select("row", "at", F.slice("symbols", (F.col("at") + 1).cast("int"), F.col("size").cast("int")).alias("symbols"))
             .toArrow())
    piece = {(row, at): x for row, at, x in zip(found["row"].to_pylist(), found["at"].to_pylist(), found["symbols"])}
    return [np.array(piece[r.row, r.at].as_py()) for r in chosen]


def baum_welch(encoded: DataFrame, usual: np.ndarray, states: int, rounds: int) -> Parameters:
    """Parameters after ``rounds`` rounds over all training texts of ``encoded``."""
    spark = encoded.sparkSession
    training = encoded.where("training")
    p = first_parameters(first_texts(training), usual, states)
    fields = ", ".join(f"s{k} double" for k in range(states))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(tuple(p))
        sums = (training.select("symbols").mapInArrow(_expecter(shared, states), f"symbol int, {fields}")
                .groupBy("symbol").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(states)]).toPandas())
        shared.unpersist()
        keys = sums["symbol"].to_numpy()
        values = sums[[f"s{k}" for k in range(states)]].to_numpy()
        emitted, moved, started = np.zeros(p.emit.shape), np.zeros((states, states)), np.zeros(states)
        emitted[keys[keys >= 0]] = values[keys >= 0]
        for key, row in zip(keys[keys < 0], values[keys < 0]):
            if key == -1 - states:
                started = row
            else:
                moved[-1 - key] = row
        occupied = emitted.sum(axis=0) + 1.0
        p = Parameters((started + 1.0) / (started.sum() + states),
                       (moved + 1.0) / (moved.sum(axis=1, keepdims=True) + states),
                       smoothed(emitted, usual), occupied / occupied.sum())
    return p


def likelihoods(p: Parameters, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """log10 of the likelihood of each list, by the scaled forward recursion over all of it."""
    begin, length = ends[:-1], np.diff(ends)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    steps = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(steps), side="left")
    total = np.zeros(len(begin))
    a = np.tile(p.start, (len(begin), 1))
    for t in range(steps):
        n = active[t]
        a = (a[:n] @ p.move if t else a[:n]) * p.emit[flat[begin[:n] + t]]
        scale = a.sum(axis=1)
        a /= scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(total))
    out[order] = total
    return out


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Parameters(*shared.value)
        for batch in batches:
            flat, ends = _flat(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(likelihoods(p, flat, ends), pa.float64())],
                                             names=["row", "forward"])
    return score


def score_texts(docs: DataFrame, training, doc_id: str = "doc_id", text: str = "text", states: int = STATES,
                rounds: int = ROUNDS, vocabulary: int = VOCABULARY) -> DataFrame:
    """(doc_id, training, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``training`` is a condition on ``docs``: rows where it holds train the counts and
    the model. Scores are log10 probabilities; the base is the add-one unigram of the
    training tokens. Null and empty texts are the end alone. Words longer than ``LONGEST`` bytes are never symbols
    of their own. Without training rows N and V are 0, every base term is 0 and the score
    equals the base. Repeated rows are scored alike; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[doc_id].alias("id"), F.coalesce(training, F.lit(False)).alias("training"), docs[text].alias("text"))
    counted = checkpointed(rows.where("training").select("text").mapInArrow(_count, "word binary, c long")
                           .groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    able = F.octet_length("word") <= LONGEST
    spread = counted.where(able & (F.col("c") > 1)).groupBy(F.floor(F.log("c") * 100)).agg(
        F.min("c").alias("c"), F.count("*").alias("n")).collect()
    least, held = 2 ** 62, 0
    for r in sorted(spread, reverse=True, key=lambda r: r.c):  # the words of these counts and above fit the table
        if held + r.n > vocabulary:
            break
        least, held = r.c, held + r.n
    frequent = sorted((bytes(r.word), r.c) for r in counted.where(able & (F.col("c") >= least)).select("word", "c").collect())
    counts = np.array([c for _, c in frequent], dtype=np.int64)
    shared = spark.sparkContext.broadcast(({w: i for i, (w, _) in enumerate(frequent)},
                                           np.log10((counts + 1) / (total + distinct + 1))))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, training boolean, symbols array<int>, base double, n long, rare array<binary>"
    encoded = checkpointed(rows.mapInArrow(_encoder(shared), schema).withColumn("row", F.monotonically_increasing_id()),
                           "symbols")
    shared.unpersist()
    rare_words = counted.where(~able | (F.col("c") < least))
    ending_of = F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(CLASSES))
    classes = {r.k: (r.words, r.kinds) for r in rare_words.groupBy(ending_of.alias("k")).agg(
        F.sum("c").alias("words"), F.count("*").alias("kinds")).collect()}
    weights = np.concatenate([counts, [classes.get(k, (0, 0))[0] for k in range(CLASSES)]]) + 1.0
    if distinct:
        model = spark.sparkContext.broadcast(tuple(baum_welch(encoded, weights / weights.sum(), states, rounds)))
        forward = encoded.select("row", "symbols").mapInArrow(_scorer(model), "row long, forward double")
    else:
        forward = encoded.select("row", F.lit(0.0).alias("forward"))
    forward = checkpointed(forward, "forward")
    room = F.array(*[F.lit(float(sum(classes.get(k, (0, 0))) + 1)) for k in range(CLASSES)])
    c = F.coalesce("c", F.lit(0))
    share = F.log10((c + 1) / F.get(room, ending_of.cast("int"))) if distinct else F.lit(0.0)
    base = F.log10((c + 1) / F.lit(float(total + distinct + 1)))
    rare = (encoded.select("row", F.explode("rare").alias("word")).join(rare_words, "word", "left")
            .groupBy("row").agg(F.sum(base).alias("rare_base"), F.sum(share).alias("rare_share"),
                                F.count(F.when(F.col("c").isNull(), 1)).alias("unknown")))
    zero = F.lit(0.0)
    return (encoded.select("row", "id", "training", "n", "base").join(forward, "row").join(rare, "row", "left")
            .select(F.col("id").alias("doc_id"), "training", F.col("n").alias("n_tokens"),
                    (F.col("n") - F.coalesce("unknown", F.lit(0))).alias("n_known"),
                    F.lit(total).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("rare_base", zero)).alias("base_score"),
                    (F.col("forward") + F.coalesce("rare_share", zero)).alias("score")))


def op9_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_texts(docs, crc32_of_id(docs["doc_id"]) % FOLDS != HELD)
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                        "base_score", "score")
