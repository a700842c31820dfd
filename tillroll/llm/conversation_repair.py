"""Operator 12: conversation structure repair by iterative-deepening A*.

A conversation's rows in order of their turns are edited until their role initials
read ``(s?(ua)+)?``: Keep (K, 0), Rerole to user or assistant (R, 1), Delete (D, 2; required
of blank and repeated rows), Insert an empty user or assistant row (I, 5); a truncated row that stays costs 5 more.

The search of one piece of a conversation is a depth-first search that tries edits in ASCII order under a cost
bound, which starts at a sure lower bound and rises to the least total that exceeded it. A state
is (rows used, place in the pattern); a transposition table holds what each failed state is known to cost at
least, across bounds and entries. The first accepting path is the cheapest, and the ASCII-least of those: the choice at
a state depends on nothing but the state, so paths of neighbouring pieces join to the path of the whole.

A conversation of any length is therefore searched in pieces of at most ``PIECE`` rows, in parallel:

1. Rows (without their texts, equal ones as one row with a count) are sorted over ranges, numbered, and marked as
   blank, repeated or truncated; consecutive rows of a conversation in a range form pieces.
2. Pieces of longer conversations are searched for the cheapest way from each place in the pattern to each other.
   A stream over these few numbers, last piece first, gives the cost of all that follows a piece.
3. Each piece is searched for its path from each place where it can begin, given the costs behind it.
4. One stream a conversation, in order and in bounded memory, follows the paths through its pieces, puts the edits
   on the texts and feeds the digest, which no job can split.

No step gathers a conversation: those who hold many rows are cut by ranges, and streams hold one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import checkpointed, table

PIECE = 128
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
OPEN, SYSTEM, USER, ASSISTANT = range(4)
#: The place behind an initial, by place and initial: the pattern ``(s?(ua)+)?``.
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: What Insert and Rerole can add at a place.
ADDS = ("user", "user", "assistant", "user")
#: Insertions that complete the pattern from a place.
TO_END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 60
SPACE = " \t\n\x0b\x0c\r"
BLANK, REPEATED, TRUNCATED = 1, 2, 3


class Piece:
    """Rows of a conversation: one initial and one fault (0, BLANK, REPEATED, TRUNCATED) each, and how often the row stands there.

    Copies of a row behind its first are repeated: each is one more Delete, directly behind the row.
    """

    def __init__(self, initials: str, faults: bytes, copies: list[int]):
        self.initials, self.faults, self.copies = initials, faults, copies
        least = [0]
        for fault, n in zip(reversed(faults), reversed(copies)):
            least.append(least[-1] + DELETE * (n - 1) + (DELETE if fault else 0))
        self.least = least[::-1]

    def edits(self, at: int, place: int, last: bool) -> Iterator[tuple[str, int, int, int]]:
        """(edit, cost, rows used, place) in ASCII order."""
        if at < len(self.faults):
            fault, more = self.faults[at], DELETE * (self.copies[at] - 1)
            yield "D", DELETE + more, at + 1, place
            yield "I", INSERT, at, AFTER[place][ADDS[place][0]]
            if fault not in (BLANK, REPEATED):
                stays = more + CUT_OFF * (fault == TRUNCATED)
                if (to := AFTER[place].get(self.initials[at])) is not None:
                    yield "K", stays, at + 1, to
                yield "R", REROLE + stays, at + 1, AFTER[place][ADDS[place][0]]
        elif last:
            yield "I", INSERT, at, AFTER[place][ADDS[place][0]]


class Search:
    """Iterative deepening over a piece whose end costs ``behind[place]``; the table serves every entry.

    ``last``: nothing follows, so rows may also be inserted at the end, and only the pattern's ends accept.
    """

    def __init__(self, piece: Piece, behind: list[int], last: bool):
        self.piece, self.behind, self.last = piece, behind, last
        self.known: dict[tuple[int, int], int] = {}
        self.floor = min(b for b in behind)

    def _bound(self, at: int, place: int) -> int:
        """What the rest costs at least."""
        return self.known.get((at, place), self.piece.least[at] + self.floor)

    def _accepts(self, at: int, place: int) -> bool:
        return at == len(self.piece.faults) and self.behind[place] < NEVER

    def _failed(self, at: int, place: int, budget: int, path: list) -> bool:
        """False with the edits in ``path`` if the rest costs ``budget`` at most; else what it costs at least is noted."""
        if self._bound(at, place) > budget:
            return True
        if self._accepts(at, place) and self.behind[place] <= budget:
            return False
        least = self.behind[place] if self._accepts(at, place) else NEVER
        for edit, cost, to, then in self.piece.edits(at, place, self.last):
            if cost <= budget and not self._failed(to, then, budget - cost, path):
                path.append((edit, then, cost))
                return False
            least = min(least, cost + self._bound(to, then))
        self.known[at, place] = max(least, budget + 1)
        return True

    def path(self, place: int) -> tuple[int, list[tuple[str, int, int]]] | None:
        """(cost with what follows, edits with the place behind them) of the best path from ``place``; None if there is none."""
        while (bound := self._bound(0, place)) < NEVER:
            found: list[tuple[str, int, int]] = []
            if not self._failed(0, place, bound, found):
                return bound, found[::-1]
        return None


def _reaches(piece: Piece, place: int, end: int) -> bool:
    """Whether any edits lead from a place to another: only a row that can be kept leads behind a system row."""
    if end == SYSTEM and place == OPEN:
        return any(i == "s" and f in (0, TRUNCATED) for i, f in zip(piece.initials, piece.faults))
    return end == place or end >= USER


def crossing(piece: Piece) -> list[int]:
    """The least costs from each place to each place (16 numbers, by entry, then exit), nothing inserted behind the last row."""
    costs = [NEVER] * 16
    for end in range(4):
        search = Search(piece, [0 if q == end else NEVER for q in range(4)], last=False)
        for place in range(4):
            if _reaches(piece, place, end) and (found := search.path(place)):
                costs[4 * place + end] = found[0]
    return costs


def paths(piece: Piece, behind: list[int] | None) -> tuple[list[str], list[int], list[int]]:
    """Audit (copies' edits included), exit and own cost from each entry; ``behind`` is None where nothing follows."""
    last = behind is None
    search = Search(piece, [0, NEVER, NEVER, 0] if last else behind, last)
    audits, exits, costs = [], [], []
    for place in range(4):
        found = search.path(place)
        if found is None:
            audits.append(""), exits.append(-1), costs.append(NEVER)
            continue
        text, at, end, cost = [], 0, place, 0
        for edit, end, own in found[1]:
            cost += own
            text.append(edit)
            if edit != "I":
                text.append("D" * (piece.copies[at] - 1))
                at += 1
        audits.append("".join(text)), exits.append(end), costs.append(cost)
    return audits, exits, costs


# -- streams over sorted rows ------------------------------------------------------------

_ORDER = ["turn", "role", "head", "digest"]
_LEGAL = ("su", "ua", "au")


def _mapped(df: DataFrame, f, schema: T.StructType) -> DataFrame:
    """``df`` through ``f`` (dicts to dicts, as a stream over each partition)."""
    own = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for at in range(0, batch.num_rows, 1000) for r in batch.slice(at, 1000).to_pylist())
        held: list[dict] = []
        for row in f(rows):
            held.append(row)
            if len(held) >= 1000:
                yield pa.RecordBatch.from_pylist(held, own)
                held = []
        yield pa.RecordBatch.from_pylist(held, own)

    return df.mapInArrow(run, schema)


class _Filling:
    """The piece that a task is filling."""

    def __init__(self, row: dict):
        self.row = {k: row[k] for k in ("conv", *_ORDER)} | {"piece": row["at"]}
        self.initials, self.faults, self.copies = [], [], []
        self.counts, self.illegal, self.turns = [0] * 4, 0, 0
        self.low = self.high = None

    def add(self, row: dict) -> None:
        initial, fault, n, turn = row["initial"], row["fault"], row["n"], row["turn"]
        self.illegal += n - 1  # two equal initials are never legal
        if self.initials:
            self.illegal += self.initials[-1] + initial not in _LEGAL
        self.counts[fault] += 1
        self.counts[BLANK if fault == BLANK else REPEATED] += n - 1
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.initials.append(initial)
        self.faults.append(fault)
        self.copies.append(n)

    def done(self, alone: bool) -> dict:
        initials, faults = "".join(self.initials), bytes(self.faults)
        return self.row | {"alone": alone, "initials": initials, "faults": faults, "copies": self.copies,
                           "blank": self.counts[BLANK], "repeated": self.counts[REPEATED], "truncated": self.counts[TRUNCATED],
                           "illegal": self.illegal, "low": self.low, "high": self.high, "turns": self.turns,
                           "costs": None if alone else crossing(Piece(initials, faults, self.copies))}


def _as_pieces(rows: Iterator[dict]) -> Iterator[dict]:
    """Rows in order to pieces. A conversation between two others of its range is alone in a piece if it fits one."""
    filling, inner, pieces = None, False, 0
    for r in rows:
        if filling is not None:
            ends = r["conv"] != filling.row["conv"]
            if ends or len(filling.initials) == PIECE:
                yield filling.done(alone=ends and inner and not pieces)
                inner, pieces = inner or ends, 0 if ends else pieces + 1
                filling = None
        filling = filling or _Filling(r)
        filling.add(r)
    if filling is not None:
        yield filling.done(alone=False)


def _costs_behind(rows: Iterator[dict]) -> Iterator[dict]:
    """Pieces of each conversation, last first: the cost of what follows each, by place (null: nothing follows)."""
    conv, behind, fresh = None, None, True
    for r in rows:
        if fresh or r["conv"] != conv:
            conv, behind, fresh = r["conv"], None, False
        yield {"piece": r["piece"], "behind": behind}
        end, c = behind or TO_END, r["costs"]
        behind = [min(c[4 * p + q] + end[q] for q in range(4)) for p in range(4)]


def _searched(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        audits, exits, costs = paths(Piece(r["initials"], r["faults"], r["copies"]), r["behind"])
        yield r | {"audits": audits, "exits": exits, "paths": costs}


class _Conversation:
    """Follows the paths through a conversation's pieces and puts their edits on its rows."""

    def __init__(self, conv):
        self.conv, self.place, self.audit, self.step, self.row = conv, OPEN, "", 0, 0
        self.copies: list[int] = []
        self.audits: list[str] = []
        self.sha, self.number, self.cost = hashlib.sha256(), 0, 0
        self.counts = dict.fromkeys(("blank", "repeated", "truncated", "illegal"), 0)
        self.low, self.high, self.turns, self.final = None, None, 0, None

    def _turn(self, edit: str, role: str, text: str, turn: int | None) -> dict:
        self.sha.update((("\n" if self.number else "") + role + ":" + text).encode("utf-8", "replace"))
        self.number += 1
        self.place = AFTER[self.place][role[0]]
        return {"conv": self.conv, "number": self.number - 1, "turn": turn, "role": role, "text": text, "edit": edit}

    def inserted(self) -> Iterator[dict]:
        """The inserted rows that stand next."""
        while self.audit[self.step:self.step + 1] == "I":
            self.step += 1
            yield self._turn("I", ADDS[self.place], "", None)

    def piece(self, r: dict) -> None:
        self.audit, self.copies, self.step, self.row = r["audits"][self.place], r["copies"], 0, 0
        self.audits.append(self.audit)
        self.cost += r["paths"][self.place]
        for k in self.counts:
            self.counts[k] += r[k]
        if self.final is not None:
            self.counts["illegal"] += self.final + r["initials"][0] not in _LEGAL
        self.final = r["initials"][-1]
        if r["turns"]:
            self.turns += r["turns"] - (r["low"] == self.high)
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]

    def text(self, r: dict) -> Iterator[dict]:
        yield from self.inserted()
        edit = self.audit[self.step]
        self.step += self.copies[self.row]
        self.row += 1
        if edit != "D":
            yield self._turn(edit, r["role"] if edit == "K" else ADDS[self.place], r["text"], r["turn"])

    def result(self) -> dict:
        return {"conv": self.conv, "gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns, **self.counts,
                "cost": self.cost, "audit": "".join(self.audits), "sha256": self.sha.hexdigest()}


def _finished(turns: bool):
    """Per conversation a head row, then its pieces, each before the rows that it covers; to results, or to repaired turns."""
    def run(rows: Iterator[dict]) -> Iterator[dict]:
        own = None
        for r in rows:
            if r["kind"] == 2:
                made = own.text(r)
            else:
                made = own.inserted() if own else iter(())
            for row in made:
                if turns:
                    yield row
            if r["kind"] == 0:
                if own and not turns:
                    yield own.result()
                own = _Conversation(r["conv"])
            elif r["kind"] == 1:
                own.piece(r)
        if own:
            for row in own.inserted():
                if turns:
                    yield row
            if not turns:
                yield own.result()
    return run


# -- the operator ------------------------------------------------------------------------

def repair(rows: DataFrame, turns: bool = False) -> DataFrame:
    """Repair the conversations of ``rows`` (conv, turn long, role, text, n long).

    ``n``: how often the row stands there, one behind the other; a conversation with n = 0 rows only is empty.
    Gives per conversation conv, gaps, blank, repeated, truncated, illegal, cost, audit, sha256 (of the repaired
    ``role:text`` lines); with ``turns`` the repaired rows instead: conv, number (from 0), turn, role, text, edit
    (K, R or I; an inserted row has no turn).

    Rows go by turn, null first; rows of one turn by role, then text (its first 64 characters, then MD5), and equal ones
    count as copies, so every order and partitioning of the input gives one result. A null role or text is one
    space; a role without a character can't be kept either. Null conversations are one conversation. 128-bit digests
    stand for the texts where repeated rows are found. An empty table gives no rows; other columns are not read.
    """
    conv = rows.schema["conv"].dataType
    of = lambda columns: T.StructType([T.StructField("conv", conv), *T._parse_datatype_string(columns).fields])
    full = rows.select("conv", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), F.col("n").cast("long").alias("n"))
    full = checkpointed(full.withColumns({"head": F.substring("text", 1, 64), "digest": F.md5(F.col("text").cast("binary"))}),
                        "conversation-rows")
    there = full.where("n > 0")
    bare = F.rtrim("text", F.lit(SPACE))
    light = there.select(
        "conv", *_ORDER, F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1)).alias("initial"),
        (bare == "").alias("empty"), F.right(bare, F.lit(1)).isin(".", "!", "?").alias("ended"), "n")
    light = light.groupBy(*[c for c in light.columns if c != "n"]).agg(F.sum("n").alias("n"))
    order = [F.col(c).asc_nulls_first() for c in ("conv", *_ORDER)]
    placed = checkpointed(light.repartitionByRange(*order).sortWithinPartitions(*order)
                          .withColumn("at", F.monotonically_increasing_id()), "conversation-order")
    first = placed.groupBy("conv", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    fault = F.when(F.col("empty"), BLANK).when(F.col("new").isNull(), REPEATED).when(~F.col("ended"), TRUNCATED).otherwise(0)
    marked = placed.join(first, "at", "left").select("conv", *_ORDER, "at", "initial", "n", fault.alias("fault"))
    key = "turn long, role string, head string, digest string, "
    summary = "blank long, repeated long, truncated long, illegal long, low long, high long, turns long, "
    pieces = checkpointed(_mapped(marked.repartitionByRange("at").sortWithinPartitions("at"), _as_pieces, of(
        key + "piece long, alone boolean, initials string, faults binary, copies array<long>, " + summary + "costs array<long>")),
        "conversation-pieces")
    long_ones = pieces.where("not alone")
    behind = _mapped(long_ones.select("conv", "piece", "costs").repartition("conv").sortWithinPartitions(
        F.col("conv").asc_nulls_first(), F.col("piece").desc()), _costs_behind, T._parse_datatype_string("piece long, behind array<long>"))
    ready = pieces.where("alone").withColumn("behind", F.lit(None).cast("array<long>")).unionByName(long_ones.join(behind, "piece"))
    found = _mapped(ready.drop("costs", "alone"), _searched, of(
        key + "piece long, initials string, copies array<long>, " + summary + "audits array<string>, exits array<int>, paths array<long>"))
    heads = full.select("conv").distinct().withColumn("kind", F.lit(0))
    texts = there.select("conv", *_ORDER, "text").distinct().withColumn("kind", F.lit(2))
    union = (heads.unionByName(found.drop("piece", "exits").withColumn("kind", F.lit(1)), allowMissingColumns=True)
             .unionByName(texts, allowMissingColumns=True))
    together = union.repartition("conv").sortWithinPartitions(
        F.col("conv").asc_nulls_first(), F.col("kind") > 0, *[F.col(c).asc_nulls_first() for c in _ORDER], "kind")
    if turns:
        return _mapped(together, _finished(True), of("number long, turn long, role string, text string, edit string"))
    return _mapped(together, _finished(False), of(
        "gaps long, blank long, repeated long, truncated long, illegal long, cost long, audit string, sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's rows: dropped (n = 0), emptied, cut off, repeated or with another role, by CRC-32 of ``conv_id:turn``."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    how = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        F.col("conv_id").alias("conv"), "turn", F.when(how == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(how == 0, "").when(how == 1, "").when(how == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(how == 0, 0).when(how == 3, 2).otherwise(1).alias("n"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged as above and repaired."""
    return repair(damaged(table(spark, sf_dir, "conversations"))).select(
        F.col("conv").alias("conv_id"), "gaps", "blank", F.col("repeated").alias("duplicate"), "truncated", "illegal", "cost", "audit",
        F.col("sha256").alias("repaired_sha256"))
