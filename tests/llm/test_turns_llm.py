"""Conversation repair: against brute force over all edits, and edge cases."""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from edge_cases import stored

from rollbook.llm import turns

START, SYSTEM, USER, ASSISTANT = range(4)
BLANK = " \t\n\x0b\x0c\r"


def brute_align(shape: str) -> tuple[int, str]:
    """Every sequence of edits, by state, with up to two inserts between turns."""

    @functools.cache
    def go(at: int, state: int, inserted: int):
        ways = [(0, "")] if at == len(shape) and state in (START, ASSISTANT) else []
        ahead = {"a": ASSISTANT} if state == USER else {"u": USER}
        if state == START:
            ahead["s"] = SYSTEM
        if inserted < 3:
            for role, after in ahead.items():
                if role != "s" and (way := go(at, after, inserted + 1)):
                    ways.append((way[0] + 2, "I" + way[1]))
        if at < len(shape):
            turn = shape[at]
            if way := go(at + 1, state, 0):
                ways.append((way[0] + 3, "D" + way[1]))
            for role, after in ahead.items() if turn != "d" else ():
                if (turn.lower() == role or role != "s") and (way := go(at + 1, after, 0)):
                    kept = turn.lower() == role
                    ways.append((way[0] + turn.isupper() + (0 if kept else 2), "KR"[not kept] + way[1]))
        return min(ways, default=None)

    return go(0, START, 0)


def test_alignment_equals_brute_force():
    shapes = ["".join(s) for n in range(4) for s in itertools.product("suaxSUAXd", repeat=n)]
    draw = random.Random(5)
    shapes += ["".join(draw.choices("suaUAxdua", k=draw.randint(4, 14))) for _ in range(300)]
    for shape in shapes:
        assert turns.align(shape) == brute_align(shape), shape


@pytest.mark.parametrize("block", [2, 3, 5])
def test_blocks_join_to_the_same_audit(monkeypatch, block):
    draw = random.Random(block)
    shapes = ["".join(draw.choices("suaUAxdua", k=draw.randint(1, 18))) for _ in range(200)]
    whole = [turns.align(s) for s in shapes]
    turns.align.cache_clear()
    monkeypatch.setattr(turns, "BLOCK", block)
    assert [turns.align(s) for s in shapes] == whole
    turns.align.cache_clear()


def brute_audit(rows: list[tuple]) -> dict:
    """The contract read word by word, over (conv, turn, role, text)."""
    convs: dict = {}
    for conv, turn, role, text in rows:
        there = convs.setdefault(conv, [])
        role, text = role if role is not None else " ", text if text is not None else " "
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        there.extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    found = {}
    for conv, there in convs.items():
        there.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, shape, faults = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in there:
            known = role[:1] if role[:1] in ("s", "u", "a") else "x"
            if not text.strip(BLANK):
                faults["blank"], known = faults["blank"] + 1, "d"
            elif (role, text) in seen:
                faults["duplicate"], known = faults["duplicate"] + 1, "d"
            elif text.rstrip(BLANK)[-1] not in ".!?":
                faults["truncated"], known = faults["truncated"] + 1, known.upper()
            seen.add((role, text))
            shape += known
        initials = [r[1][:1] for r in there]
        numbers = [r[0] for r in there if r[0] is not None]
        cost, audit = brute_align(shape)
        size = len(audit) - audit.count("D")
        target = "s" * (size % 2) + "ua" * (size // 2)
        lines, left, place = [], iter(there), 0
        for edit in audit:
            _, role, text = next(left) if edit != "I" else (None, None, "")
            if edit != "D":
                name = role if edit == "K" else {"u": "user", "a": "assistant"}[target[place]]
                lines.append(f"{name}:{text}")
                place += 1
        found[conv] = {
            "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            **faults,
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
            "cost": cost,
            "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        }
    return found


EXTRA = "place BIGINT, edits STRING, mark INT, copies STRING, blank BIGINT, row_index BIGINT"


def table(spark, rows, path):
    frame = spark.createDataFrame([(*r, 5, "x", None, "y", 3, 9) for r in rows],
                                  f"conv_id BIGINT, turn BIGINT, role STRING, text STRING, {EXTRA}")
    return stored(spark, frame, path)


def edge_rows() -> list[tuple]:
    draw = random.Random(9)
    texts = ["Yes.", "no", "", " \t", "é!", "What?\n", "x" * 50_000 + ".", None, "a. b", "\x1c", "\xa0"]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "umpire"]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(draw.randint(1, 9)):
            at = draw.choice([turn, turn, turn, 3, None, -(2**40)])
            rows.append((conv, at, draw.choice(roles[:3] * 3 + roles), draw.choice(texts[:3] + texts)))
            if draw.random() < 0.2:
                rows += [rows[-1]] * draw.randint(1, 4)
    rows += [(100, n, "ua"[n % 2], f"t{n}.") for n in range(8)]
    return rows


def test_whole_tables_equal_brute_force(spark, tmp_path):
    rows = edge_rows()
    got = turns.audited(table(spark, rows, tmp_path / "c"), stored=True).collect()
    want = brute_audit(rows)
    assert len(got) == len(want)
    for r in got:
        assert {k: v for k, v in r.asDict().items() if k != "conv_id"} == want[r.conv_id], r.conv_id


def test_layout_does_not_matter(spark, tmp_path):
    rows = edge_rows()
    random.Random(1).shuffle(rows)
    one = turns.audited(table(spark, rows, tmp_path / "a"), stored=True).collect()
    two = turns.audited(table(spark, edge_rows(), tmp_path / "b").repartition(7)).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


def test_one_conversation_holds_most_rows(spark, tmp_path):
    """Longer than a block many times over, half of it copies of a turn."""
    rows = [(1, n, "assistant" if n % 2 else "user", f"text {n % 400}.") for n in range(900)]
    rows += [(1, 4, "user", "text 4.")] * 900 + [(2, 1, "user", "a.")]
    got = {r.conv_id: r.asDict() for r in turns.audited(table(spark, rows, tmp_path / "c"), stored=True).collect()}
    want = brute_shape_only(rows)
    assert (got[1]["cost"], got[1]["duplicate"]) == want
    assert len(got[1]["audit"]) - got[1]["audit"].count("I") == want_rows(rows)


def want_rows(rows) -> int:
    return sum({0: 0, 3: 2}.get(zlib.crc32(f"{c}:{t}".encode()) % 20, 1) for c, t, _, _ in rows if c == 1)


def brute_shape_only(rows) -> tuple[int, int]:
    """Cost by a plain pass over states, without audits."""
    there = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if conv == 1 and kind:
            text = "" if kind == 1 else text.replace(".", "") if kind == 2 else text
            there += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    there.sort()
    none = float("inf")
    costs, seen, copies = [0, none, none, none], set(), 0

    def inserted(c):
        c = list(c)
        for _ in range(2):
            c[USER] = min(c[USER], 2 + min(c[START], c[SYSTEM], c[ASSISTANT]))
            c[ASSISTANT] = min(c[ASSISTANT], 2 + c[USER])
        return c

    for _, role, text in there:
        c = inserted(costs)
        costs = [v + 3 for v in c]
        if text and (role, text) not in seen:
            cut = text[-1] != "."
            user, other = min(c[START], c[SYSTEM], c[ASSISTANT]), c[USER]
            costs[USER] = min(costs[USER], user + cut + (0 if role == "user" else 2))
            costs[ASSISTANT] = min(costs[ASSISTANT], other + cut + (0 if role == "assistant" else 2))
        elif text:
            copies += 1
        seen.add((role, text))
    c = inserted(costs)
    return min(c[START], c[ASSISTANT]), copies


def test_empty_table(spark, tmp_path):
    assert turns.audited(table(spark, [], tmp_path / "c"), stored=True).collect() == []


def test_repaired_turns(spark, tmp_path):
    """Without damage: what stands, what is renamed, what is made."""
    rows = [(1, 1, "system", "Be kind."), (1, 2, "user", "Hi."), (1, 3, "user", "There?"), (2, 1, "assistant", "So.")]
    frame = turns.prepared(turns.numbered_turns(table(spark, rows, tmp_path / "c"), stored=True))
    judged, repaired = turns.repair(frame)
    assert {r.conv_id: (r.cost, r.audit) for r in judged.collect()} == {1: (2, "KKR"), 2: (2, "IK")}
    got = [tuple(r) for r in repaired.orderBy("conv_id", "place").collect()]
    assert got == [
        (1, 0, "system", "Be kind.", "K"),
        (1, 1, "user", "Hi.", "K"),
        (1, 2, "assistant", "There?", "R"),
        (2, 0, "user", "", "I"),
        (2, 1, "assistant", "So.", "K"),
    ]
