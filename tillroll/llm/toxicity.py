"""Operator 8: toxicity by class-conditional Kneser-Ney models.

Each class has a Kneser-Ney model of its expressions. The count of a word is
the Kneser-Ney continuation count: the number of distinct words it follows in
texts of the class, so that a word repeated in one text or in copies of it
counts little. Both models back off to the same counts, pooled over the classes:

    p_c(w) = max(k_c(w) - D - K (N_c / N_o) (k_o(w) + B), 0) / N_c  +  l_c p_shared(w)

with ``o`` the other class. The discount takes off what the shared counts explain -
``K`` times what the other class lets expect, ``B`` more contexts for words it may
hold unseen, and the absolute discount ``D`` - and ``l_c`` is the mass
taken off. A rare or an evenly spread expression is left to the shared counts, where
it has the same probability in both models up to ``l_toxic / l_ordinary``; only expressions one
class really prefers weigh. A text's evidence is the difference of the two log-likelihoods divided by its
words, so that long texts are not judged by their length.

The models are fitted on a bounded sample of the labelled rows, ``TOXIC_ROWS`` and
``ORDINARY_ROWS`` at most, of least id hash; three quarters are counted, and the others
set the threshold. Every text is scored whole.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, crc32_of_id, free_name, table, with_values

TOXIC_ROWS = 2_000
ORDINARY_ROWS = 8_000
DISCOUNT = 3.0
SPREAD = 3.0
UNSEEN = 1.0
FOLDS = 5
_WORDS = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


@dataclass
class Model:
    """The log ratio of every word one class prefers, that of all others, and the threshold's place and scale."""

    known: dict[str, float] = field(default_factory=dict)
    other: float = 0.0
    threshold: float = 0.0
    scale: float = 1.0
    constant: float | None = None

    def evidence(self, text: str | None) -> float:
        """log p_toxic - log p_ordinary, a word; a text without words has that of an unknown word."""
        own = words(text)
        if not own:
            return self.other
        get = self.known.get
        return self.other + math.fsum(x - self.other for x in map(get, own) if x is not None) / len(own)

    def score(self, text: str | None) -> float:
        """0 to 1, rising with the evidence, 0.5 at the threshold."""
        if self.constant is not None:
            return self.constant
        z = (self.evidence(text) - self.threshold) / self.scale
        return 0.5 + 0.5 * z / (1.0 + abs(z))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct (word before, word) of every text; the first word follows the empty word."""
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = words(text)
            found = list(dict.fromkeys(zip(["", *own], own)))
            for at in range(0, len(found), 10_000):
                some = found[at:at + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label] * len(some), pa.int32()), pa.array([a for a, _ in some], pa.string()),
                     pa.array([b for _, b in some], pa.string())], names=["toxic", "before", "word"])


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(toxic, part, text) of the bounded sample; part 0 sets the threshold, parts 1 to 3 are counted.

    Rows whose id's CRC-32 leaves no rest by ``FOLDS`` are held out. An id with several labels has the larger.
    The bound counts rows: where labelled ids repeat in ``docs``, only the first rows by id hash and text hash are taken.
    """
    own = (labels.where("doc_id is not null and toxic is not null").where(crc32_of_id(F.col("doc_id")) % FOLDS != 0)
           .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id")))
    some = own.where("toxic = 1").orderBy("h", "doc_id").limit(TOXIC_ROWS).unionByName(
        own.where("toxic = 0").orderBy("h", "doc_id").limit(ORDINARY_ROWS))
    some = checkpointed(some.select(F.col("doc_id").alias("id"), "toxic", F.pmod("h", F.lit(4)).alias("part")), "sample-ids")
    rows = docs.select(docs[doc_id].alias("id"), docs[text].alias("text"))
    found = rows.join(F.broadcast(some), "id").withColumns({"h": F.xxhash64("id"), "t": F.xxhash64("text")})
    found = found.where("toxic = 1").orderBy("h", "t", "text").limit(TOXIC_ROWS).unionByName(
        found.where("toxic = 0").orderBy("h", "t", "text").limit(ORDINARY_ROWS))
    return checkpointed(found.select("toxic", "part", "text"), "sample")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """The model from the labelled rows. Without rows of both classes its score is the share of toxic labels."""
    rows = sample(docs, labels, doc_id, text)
    counted = rows.where("part <> 0").select("toxic", "text").mapInArrow(_pairs, "toxic int, before string, word string")
    table_ = checkpointed(counted.distinct().groupBy("word").agg(
        F.count(F.when(F.col("toxic") == 1, 1)).alias("k1"), F.count(F.when(F.col("toxic") == 0, 1)).alias("k0")), "words")
    n1, n0, v = table_.agg(F.coalesce(F.sum("k1"), F.lit(0)), F.coalesce(F.sum("k0"), F.lit(0)), F.count("*")).first()
    prior, = labels.where("doc_id is not null and toxic is not null").where(
        crc32_of_id(F.col("doc_id")) % FOLDS != 0).agg(F.avg(F.col("toxic").cast("double"))).first()
    if not n1 or not n0:
        return Model(constant=float(prior or 0.0))

    def own(k: str, o: str, nk: int, no: int):
        return F.greatest(F.col(k) - DISCOUNT - SPREAD * nk / no * (F.col(o) + UNSEEN), F.lit(0.0)) / nk

    mass = table_.select("word", "k1", "k0", own("k1", "k0", n1, n0).alias("m1"), own("k0", "k1", n0, n1).alias("m0"))
    kept = [(r.word, r.m1, r.m0, (r.k1 + r.k0 + 1) / (n1 + n0 + v + 1)) for r in mass.where("m1 > 0 or m0 > 0").collect()]
    kept.sort()
    l1, l0 = 1.0 - math.fsum(r[1] for r in kept), 1.0 - math.fsum(r[2] for r in kept)
    model = Model({w: math.log((m1 + l1 * p) / (m0 + l0 * p)) for w, m1, m0, p in kept}, math.log(l1 / l0))
    _place(model, rows, float(prior))
    return model


def _place(model: Model, rows: DataFrame, prior: float) -> None:
    """Put the threshold where most of the rows held back for it are right, weighed as the classes are among all labels."""
    seen = with_values(rows.where("part = 0").select("toxic", "text"), "text", lambda ts: [model.evidence(t) for t in ts],
                       "evidence", T.DoubleType(), keep_text=False).collect()
    found = sorted((r.evidence, r.toxic) for r in seen)
    ones = sum(t for _, t in found)
    zeros = len(found) - ones
    if not ones or not zeros:
        model.threshold, model.scale = model.other + 0.01, 0.01
        return
    gain = {1: prior / ones, 0: -(1.0 - prior) / zeros}
    best, right, at = 0.0, 0.0, len(found)
    for i in range(len(found) - 1, -1, -1):  # rows from i on are called toxic
        right += gain[found[i][1]]
        if right > best and (i == 0 or found[i - 1][0] < found[i][0]):
            best, at = right, i
    if at == len(found):
        model.threshold = found[-1][0] + 0.01
    else:
        model.threshold = found[at][0] if at == 0 else (found[at][0] + found[at - 1][0]) / 2
    below = [abs(e - model.threshold) for e, _ in found]
    model.scale = max(sorted(below)[len(below) // 2], sys.float_info.epsilon * 1e6)


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
             into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with a score (0 to 1) and ``predicted`` (1 if the score is at least 0.5).

    ``labels``: (doc_id, toxic 0/1, null: none). Null and empty texts have no
    words and get the score of no evidence; repeated rows are scored alike. Only the text is an input.
    Without labels of both classes the score is the share of toxic ones (0 without labels). An empty table
    gives no rows. All columns of ``docs`` are kept; where they have a name of ``into``, the new column gets underscores.
    """
    model = fit(docs, labels, doc_id, text)
    score, predicted = (free_name(docs, x) for x in into)
    scored = with_values(docs, text, lambda ts: [model.score(t) for t in ts], score, T.DoubleType())
    return scored.withColumn(predicted, (F.col(score) >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    score, predicted = free_name(docs, "toxic_score"), free_name(docs, "toxic_predicted")
    return toxicity(docs, labels, doc_id, text, (score, predicted)).where(F.col(predicted) == 0).select(*docs.columns)


def op8_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc32_of_id(F.col("doc_id")) % FOLDS == 0).alias("held_out"), "score", "predicted")
