"""Operator 11: best-fit packing of documents into sequences by linear grouping.

1. Every text is tokenised whole (a very long one in parts, cut at places where the tokeniser splits anyway) and closed by ``END``. A document of more than ``capacity`` ids
   is cut into pieces of ``capacity``; the first piece takes the remainder. Only (document, piece, start, length, CRC)
   is kept, unless the ids are asked for.
2. Spark counts the pieces of each length: at most ``capacity`` rows, whatever the corpus. Only this table
   reaches the driver, which plans on it:

   * *Linear grouping*: large lengths (above ``capacity / SMALL``) in descending order form ``GROUPS`` groups of
     equal cardinality, each rounded up to its largest length.
   * *Configurations*: the cutting-stock linear program over the rounded lengths, solved by column generation
     (simplex on one row a group, knapsack for the next configuration), rounded down to whole sequences.
   * *Substitution*: the slots of a group take its actual documents, longest first.
   * *Best fit*: what is left, and the small lengths, go in descending order to the fullest sequence that has
     room, or to a new one.

   Sequences that look alike are one entry with a count, so that the plan has a few thousand entries at any scale.
3. Spark numbers the pieces of each length without gaps (counts by part of the piece table and length, so
   that a length that a third of all pieces share is no task of its own), and every piece looks its place up.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, free_name, table

CAPACITY = 2048
END = 0
SMALL = 8
GROUPS = 64
_STRETCH = 1_000_000
_VISIBLE = r"[^\s\u180e\u200b\u2060\ufeff]"
#: A single space between two visible characters always opens a new pre-token, so ids on both sides are independent.
_CUT = re.compile(f"(?<={_VISIBLE}) (?={_VISIBLE})")
#: Blocks in which every Unicode version agrees on letters, digits and spaces: Latin, Cyrillic, dashes and quotes, euro, kana, CJK.
_SURE = re.compile("[\x00-\x1b\x20-\u024f\u0400-\u0481\u2010-\u2027\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]*")


# -- tokens -------------------------------------------------------------------------

def _fast_form(path: str):
    """The same byte-level BPE for ``tiktoken``, which is several times as fast; None where a file is of another kind.

    Its ranks are the file's ids, which must be in the order of the merges.
    """
    import tiktoken
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    model, before = own["model"], own["pre_tokenizer"]
    if (model["type"] != "BPE" or own["normalizer"] or model.get("dropout") or model.get("ignore_merges")
            or {k: before.get(k) for k in ("type", "add_prefix_space", "use_regex")} != {
                "type": "ByteLevel", "add_prefix_space": False, "use_regex": True}):
        return None
    special = {x["content"] for x in own["added_tokens"]}
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that stand for themselves
    hidden = [b for b in range(256) if b not in visible]
    byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != sorted(merged):
        return None
    # fixed value: the pre-token pattern of the byte-level BPE, in a form that never backtracks
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
    return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), special


class Encoder:
    """Texts to ids (32-bit, little-endian) as ``tokenizers`` gives them for a file, without special tokens added.

    Texts whose letters, digits and spaces are beyond doubt (``_SURE``) and that hold no special token take the fast form
    of the same vocabulary; all others go to ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks fill the cores already
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.fast, self.special = _fast_form(path) or (None, set())

    def _ids(self, text: str) -> list[int]:
        if self.fast and (text.isascii() or _SURE.fullmatch(text)) and not any(x in text for x in self.special):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str | None) -> bytes:
        return b"".join(array("I", self._ids(x)).tobytes() for x in _stretches(text or ""))


def _stretches(text: str) -> Iterator[str]:
    """A text in parts of about ``_STRETCH`` characters, cut at places of ``_CUT``."""
    at = 0
    while len(text) - at > _STRETCH and (m := _CUT.search(text, at + _STRETCH)):
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: only longer documents are cut, and the first piece takes the remainder."""
    first = n % capacity or capacity if n > capacity else n
    return [(0, first), *[(a, capacity) for a in range(first, n, capacity)]]


def pieces(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           end: int | None = END, keep_ids: bool = False) -> DataFrame:
    """One row per piece: (``doc_id``, piece, start, length, ids_crc32[, ids binary]).

    A null text counts as empty. An empty text is its end id; without one (``end=None``) it has no piece.
    Special tokens in a text come out as the file's tokenizer reads them.
    """
    out = [("doc_id", docs.schema[doc_id].dataType), ("piece", T.IntegerType()), ("start", T.LongType()),
           ("length", T.LongType()), ("ids_crc32", T.LongType())] + [("ids", T.BinaryType())] * keep_ids
    names = [n for n, _ in out]
    close = b"" if end is None else np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = Encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, of = [], []
                for k, text in enumerate(part.column(1)):
                    ids = encoded(text.as_py()) + close
                    for i, (start, n) in enumerate(cut(len(ids) // 4, capacity) if ids else []):
                        own = ids[4 * start:4 * (start + n)]
                        rows.append((i, start, n, zlib.crc32(own), own)[:len(names) - 1])
                        of.append(k)
                columns = list(zip(*rows)) or [[]] * (len(names) - 1)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of, pa.int32())), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=names)

    return docs.select(docs[doc_id], docs[text]).toDF("doc_id", "text").mapInArrow(
        run, T.StructType([T.StructField(n, t) for n, t in out]))


# -- the plan, on counts by length -----------------------------------------------------

def grouped(counts: dict[int, int], least: int, groups: int) -> list[tuple[int, list[list[int]]]]:
    """Linear grouping: (rounded length, [[length, count], ...]) of groups of equal cardinality, longest first.

    The pieces of one length can belong to two neighbouring groups. Groups of equal rounded length are one.
    """
    large = [[n, counts[n]] for n in sorted(counts, reverse=True) if n > least and counts[n]]
    size = -(-sum(c for _, c in large) // groups) or 1
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for n, c in large:
        while c:
            if not room:
                if out and out[-1][0] == n:
                    room = size
                    continue
                out.append((n, []))
                room = size
            take = min(c, room)
            out[-1][1].append([n, take])
            c, room = c - take, room - take
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """The cutting-stock linear program by column generation: (pieces of each size, how many sequences)."""
    k = len(sizes)
    w, d = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag((capacity // w).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    value = inverse @ d
    for _ in range(40 * k + 100):
        price = np.maximum(inverse.sum(axis=0), 0.0)  # every configuration costs one sequence
        column = _knapsack(w, price, capacity)
        if price @ column <= 1 + 1e-9:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-10, value / np.where(step > 1e-10, step, 1.0), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        value = np.maximum(inverse @ d, 0.0)
    return [(basis[:, i].astype(int).tolist(), float(value[i])) for i in range(k) if value[i] > 0]


def _knapsack(w: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable multiset of sizes within the capacity, as counts."""
    order = np.argsort(w, kind="stable")
    ws, ps = w[order], price[order]
    fits = np.searchsorted(ws, np.arange(capacity + 1), side="right")
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if fits[room]:
            gain = best[room - ws[:fits[room]]] + ps[:fits[room]]
            i = int(gain.argmax())
            if gain[i] > best[room] + 1e-12:
                best[room], last[room] = gain[i], i
    out, room = np.zeros(len(w)), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            out[order[last[room]]] += 1
            room -= int(ws[last[room]])
    return out


class Place(NamedTuple):
    """Pieces ``first ... first + count - 1`` of a length: ``each`` of them to a sequence, from ``sequence`` on, at ``offset``."""

    length: int
    first: int
    count: int
    each: int
    sequence: int
    offset: int


class _Packer:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.used = dict(counts), defaultdict(int)
        self.capacity, self.sequences = capacity, 0
        self.places: list[Place] = []
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by room: (first sequence, count)
        self.rooms: list[int] = []

    def put(self, length: int, count: int, each: int, sequence: int, offset: int) -> None:
        self.places.append(Place(length, self.used[length], count, each, sequence, offset))
        self.used[length] += count
        self.left[length] -= count

    def leave(self, room: int, first: int, count: int) -> None:
        if count and room:
            if not self.open[room]:
                self.rooms.insert(bisect_left(self.rooms, room), room)
            self.open[room].append((first, count))

    def substitute(self, config: list[int], many: int, groups: list[list[list[int]]]) -> None:
        """``many`` sequences of a configuration: its slots take the longest documents that their groups still have."""
        alike = [(self.sequences, many, 0)]  # (first, count, filled)
        self.sequences += many
        for g, slots in enumerate(config):
            for _ in range(slots):
                new = []
                for first, count, filled in alike:
                    while count and groups[g]:
                        n, c = groups[g][0]
                        take = min(c, count)
                        self.put(n, take, 1, first, filled)
                        new.append((first, take, filled + n))
                        first, count = first + take, count - take
                        groups[g][0][1] -= take
                        if take == c:
                            groups[g].pop(0)
                    if count:
                        new.append((first, count, filled))
                alike = new
        for first, count, filled in alike:
            self.leave(self.capacity - filled, first, count)

    def best_fit(self, length: int) -> None:
        """The rest of a length: to the least room that holds it, again and again, then to new sequences."""
        while c := self.left[length]:
            at = bisect_left(self.rooms, length)
            if at < len(self.rooms):
                room = self.rooms[at]
                first, count = self.open[room].pop()
                if not self.open[room]:
                    self.rooms.pop(at)
            else:
                room, first = self.capacity, self.sequences
                count = -(-c // (room // length))
                self.sequences += count
            each = room // length
            full = min(count, c // each)
            offset = self.capacity - room
            if full:
                self.put(length, full * each, each, first, offset)
                self.leave(room - each * length, first, full)
            if full < count and (some := min(self.left[length], each - 1)):
                self.put(length, some, some, first + full, offset)
                self.leave(room - some * length, first + full, 1)
                full += 1
            self.leave(room, first + full, count - full)


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> list[Place]:
    """Where the pieces of each length (1 to ``capacity``) go; ``counts`` has their numbers."""
    packer = _Packer(counts, capacity)
    own = grouped({n: c for n, c in counts.items() if n < capacity}, capacity // small, groups)
    if own:
        members = [m for _, m in own]
        for config, many in configurations([n for n, _ in own], [sum(c for _, c in m) for m in members], capacity):
            if whole := int(many + 1e-6):
                packer.substitute(config, whole, members)
    for length in sorted(counts, reverse=True):
        packer.best_fit(length)
    return packer.places


# -- the operator ------------------------------------------------------------------------

def packed(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           end: int | None = END, keep_ids: bool = False) -> DataFrame:
    """The rows of ``pieces`` with ``sequence_id`` and ``offset``: sequences of at most ``capacity`` ids, filled from 0 without gaps.

    Rows are packed one by one: repeated rows and null ids are pieces of their own. A null text counts as
    empty (its end id alone). An empty table gives no rows; other columns than the id and the text are not read.
    """
    raw = pieces(docs, tokenizer, doc_id, text, capacity, end, keep_ids)
    rows = checkpointed(raw.withColumn("row", F.monotonically_increasing_id()), "pieces")
    part = F.shiftright("row", 33).alias("part")
    by = rows.groupBy(part, "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("part", "length").orderBy("row"))
    ranked = (rows.withColumn("part", part).withColumn("at", within).join(base, ["part", "length"])
              .select(*raw.columns, (F.col("base") + F.col("at") - 1).alias("rank")))
    plan = sorted(packing_plan(counts, capacity))
    plan_rows = np.array(plan or np.zeros((0, 6)), dtype=np.int64)
    starts = plan_rows[:, 0] * 2 ** 48 + plan_rows[:, 1]  # by length, then number: no length has 2^48 pieces
    spread = docs.sparkSession.sparkContext.broadcast((plan_rows, starts))  # bounded by the capacity, not the corpus
    at = raw.columns.index("length")

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_rows, starts = spread.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (at, batch.num_columns - 1))
            p = plan_rows[np.searchsorted(starts, length * 2 ** 48 + rank, side="right") - 1]
            k = rank - p[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(p[:, 4] + k // p[:, 3]), pa.array(p[:, 5] + k % p[:, 3] * length)], names=out.names)

    out = T.StructType([*ranked.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(look_up, out).withColumnRenamed("doc_id", doc_id)


def sequences(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
              end: int | None = END) -> DataFrame:
    """The packed sequences: (sequence_id, ids array<long>, pieces array<struct<doc_id, start, length, offset>>); a group is one sequence."""
    own = packed(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), tokenizer, capacity=capacity, end=end, keep_ids=True)
    joined = own.groupBy("sequence_id").agg(F.sort_array(F.collect_list(
        F.struct("offset", "doc_id", "start", "length", "ids"))).alias("of"))
    plain = joined.select("sequence_id", F.array_join(F.transform("of", lambda p: F.hex(p["ids"])), "").alias("hex"), F.transform(
        "of", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["length"].alias("length"),
                                 p["offset"].alias("offset"))).alias("pieces"))
    byte = lambda i, k: F.substring("hex", i * 8 + 2 * k + 1, F.lit(2))
    number = lambda i: F.conv(F.concat(*[byte(i, k) for k in (3, 2, 1, 0)]), 16, 10).cast("long")
    many = (F.length("hex") / 8).cast("int")
    return plain.select("sequence_id", F.transform(F.sequence(F.lit(0), many - 1), number).alias("ids"), "pieces")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
