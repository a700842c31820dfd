import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillroll.llm import conversation_repair as C
from tillroll.llm.conversation_repair import Piece, crossing, damaged, op12_conversation_repair, paths, repair

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def is_blank(text):
    return not text.strip(" \t\n\x0b\x0c\r")


def faults_of(rows):
    out, seen = [], set()
    for role, text in rows:
        if is_blank(text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_edits(initials, faults):
    """Cheapest (cost, audit) by tables from the end: the best pair of every state, insertions relaxed until nothing changes."""
    n = len(initials)
    best = {}
    for i in range(n, -1, -1):
        for q in ("", "s", "u", "a"):
            options = [(0, "")] if i == n and q in ("", "a") else []
            if i < n:
                stay = 5 * (faults[i] == "truncated")
                c, t = best[i + 1, q]
                options.append((c + 2, "D" + t))
                if faults[i] not in ("blank", "duplicate"):
                    if (q, initials[i]) in NEXT:
                        c, t = best[i + 1, NEXT[q, initials[i]]]
                        options.append((c + stay, "K" + t))
                    c, t = best[i + 1, "a" if q == "u" else "u"]
                    options.append((c + stay + 1, "R" + t))
            best[i, q] = min(options, default=(10 ** 9, ""))
        for _ in range(4):
            for q in ("", "s", "u", "a"):
                c, t = best[i, "a" if q == "u" else "u"]
                best[i, q] = min(best[i, q], (c + 5, "I" + t))
    return best[0, ""]


def brute(conv_id, rows):
    """rows: (turn, role, text) of one conversation as in the table."""
    after = []
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}"
        how = zlib.crc32(key.encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else "".join(x for x in text if x not in ".!?") if how == 2 else text
        after += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    own = [(r, t) for _, r, t in after]
    faults, initials = faults_of(own), [(r or " ")[0] for r, _ in own]
    turns = {t for t, _, _ in after if t is not None}
    cost, audit = brute_edits(initials, faults)
    out, at, place = [], 0, ""
    for edit in audit:
        role, text = ("", "") if edit == "I" else own[at]
        at += edit != "I"
        if edit != "D":
            role = role if edit == "K" else "assistant" if place == "u" else "user"
            out.append(f"{role}:{text}")
            place = role[0]
    return (conv_id, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute_table(rows):
    by = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    return [brute(k, v) for k, v in by.items()]


CODES = {"": 0, "blank": C.BLANK, "duplicate": C.REPEATED, "truncated": C.TRUNCATED}
ROWS = st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from(list(CODES))), max_size=14)


@settings(max_examples=300, deadline=None)
@given(ROWS)
def test_search_is_cheapest_and_least(rows):
    initials, faults = "".join(i for i, _ in rows), [f for _, f in rows]
    piece = Piece(initials, bytes(CODES[f] for f in faults), [1] * len(rows))
    audits, _, costs = paths(piece, None)
    assert (costs[0], audits[0]) == brute_edits(initials, faults)


@settings(max_examples=100, deadline=None)
@given(st.lists(ROWS, min_size=3, max_size=3))
def test_pieces_join_to_the_whole(parts):
    made = [Piece("".join(i for i, _ in p), bytes(CODES[f] for _, f in p), [1] * len(p)) for p in parts]
    behind = [None] * 3
    for k in (1, 0):
        end, c = behind[k + 1] or C.TO_END, crossing(made[k + 1])
        behind[k] = [min(c[4 * p + q] + end[q] for q in range(4)) for p in range(4)]
    place, audit, cost = C.OPEN, "", 0
    for piece, rest in zip(made, behind):
        audits, exits, costs = paths(piece, rest)
        audit, cost, place = audit + audits[place], cost + costs[place], exits[place]
    rows = [r for p in parts for r in p]
    assert (cost, audit) == brute_edits("".join(i for i, _ in rows), [f for _, f in rows])


def test_copies_are_deleted_behind_their_row():
    audits, _, costs = paths(Piece("ua", bytes([0, 0]), [3, 1]), None)
    assert (audits[0], costs[0]) == ("KDDK", 4)
    audits, _, costs = paths(Piece("xua", bytes([C.BLANK, 0, 0]), [2, 1, 1]), None)
    assert (audits[0], costs[0]) == ("DDKK", 4)


def test_long_pieces_are_searched():
    rng = random.Random(12)
    for letters in ("u", "a", "ua", "suax"):
        initials = [rng.choice(letters) for _ in range(C.PIECE)]
        faults = [rng.choice(["", "", "", "truncated", "blank"]) for _ in initials]
        audits, _, costs = paths(Piece("".join(initials), bytes(CODES[f] for f in faults), [1] * C.PIECE), None)
        assert (costs[0], audits[0]) == brute_edits(initials, faults)


def test_whole_table(spark, sf01):
    rows = spark.read.parquet(f"{sf01}/conversations.parquet")
    got = op12_conversation_repair(spark, sf01)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(brute_table(rows.collect()))


@pytest.mark.parametrize("piece", [C.PIECE, 3])
def test_hot_and_odd_conversations(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(C, "PIECE", piece)
    rng = random.Random(5)
    said = ["A text.", "Another one", "  ", "", None, "More!\n", "What?", "it ends here "]
    role = ["user", "assistant", "system", "tool", "", None]
    rows = [(k % 7, rng.choice([None, *range(6)]), rng.choice(role), rng.choice(said), k) for k in range(150)]
    rows += [(None, rng.choice([None, *range(300)]), rng.choice(role), f"{rng.random()}" if k % 2 else rng.choice(said), k) for k in range(400)]
    rows += [(None, None, None, None, None)] * 20 + [(99, t, None, None, 1) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conv long")
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(repr, map(tuple, op12_conversation_repair(spark, str(tmp_path)).collect())))
    assert got == sorted(map(repr, brute_table(df.collect())))


def test_repaired_turns(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "Yes."), (1, 2, "user", "And?"), (2, 1, "user", "Hi!"), (2, 2, "assistant", "Hello.")],
                               "conv_id long, turn long, role string, text string").withColumnsRenamed({"conv_id": "conv"})
    got = sorted(map(tuple, repair(df.selectExpr("*", "1 as n"), turns=True).collect()))
    assert got == [(1, 0, 1, "user", "Yes.", "R"), (1, 1, 2, "assistant", "And?", "R"),
                   (2, 0, 1, "user", "Hi!", "K"), (2, 1, 2, "assistant", "Hello.", "K")]


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair(damaged(df)).count() == 0 and repair(damaged(df), turns=True).count() == 0
