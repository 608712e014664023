"""Repair of conversations whose turns break the alternation of their roles.

A repaired conversation is empty, or reads ``user, assistant`` one or more times, with at
most one system turn before. The cheapest edits that lead there are found by target
alignment: the turns are aligned with each feasible length of the alternating string by
the recurrence of Wagner and Fischer, within Ukkonen's band for the cost of the best
alignment so far, and the backtraced audits of equal costs are compared.

Order of turns: by ``turn``, nulls first, then by role, then by text, all by code point.
Faults, the first that fits: ``blank`` (no character but white space), ``duplicate`` (role
and text stand earlier in the conversation), ``truncated`` (the last character that is not
white space is not one of ``.!?``). Edits and costs: Keep 0, Rerole to user or assistant
2, Delete 3 (needed for blank and duplicate turns), Insert an empty turn of user or
assistant 2; a truncated turn that stays costs 1 more.

How large conversations are handled: equal rows are counted before they are shuffled.
A conversation of any length is aligned in blocks of ``BLOCK`` turns, each for every state
it may be entered in and left in, and the blocks are joined pair by pair, which gives the
same audits as one alignment. Only an audit, which is a value of the result, and a batch of
turns are held at a time.

Defined results: null roles and texts are one blank, which is what a null counts as here;
null conversations are one conversation. A table without rows gives none. A conversation
whose rows are all absent has zeros and an empty audit. ``gaps`` beyond a long is null.
Other columns are left out, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rollbook.llm.shared import ROW, numbered
from rollbook.sources.staging import stage

#: Fixed by the contract.
RETAG, DELETE, INSERT, CUT = 2, 3, 2, 1
_BLANKS = " \t\n\x0b\x0c\r"
_NAMES = {"u": "user", "a": "assistant"}

BLOCK = 32

#: States between two turns of the target: nothing yet, after the system turn, after a
#: user's, after an assistant's. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}


# ------------------------------------------------------------------ one alignment


def _targets(entry: int, length: int) -> list[str]:
    """The strings of that many roles that may follow a state."""
    first = "au" if entry == USER else "ua"
    plain = (first * (length // 2 + 1))[:length]
    if entry == START and length:
        return [plain, ("s" + first * (length // 2 + 1))[:length]]
    return [plain]


def _aligned(turns: str, target: str, bound: float) -> tuple[int, str] | None:
    """The least cost of turning the turns into the target, with the least audit of that
    cost; None if it is above the bound.

    A turn is its role's initial, ``x`` for any other, upper case if truncated, or ``d``
    if it has to go. ``rest[i][j]`` is the cost from turn i and role j on. A cell is left
    out if the inserts and deletes that lead to it and from it cost more than the bound.
    """
    n, m = len(turns), len(target)
    stays = [0]  # turns that may stay among the first i
    for t in turns:
        stays.append(stays[-1] + (t != "d"))
    forced = DELETE * (n - stays[n])

    def drift(surplus: int) -> int:
        return DELETE * surplus if surplus > 0 else -INSERT * surplus

    def banded(i: int, j: int) -> bool:
        return forced + drift(stays[i] - j) + drift(stays[n] - stays[i] - (m - j)) <= bound

    def match(turn: str, role: str) -> float:
        if turn == "d":
            return float("inf")
        extra = CUT if turn.isupper() else 0
        if turn.lower() == role:
            return extra
        return RETAG + extra if role != "s" else float("inf")

    rest: list[dict[int, float]] = [{} for _ in range(n + 1)]
    none = float("inf")
    for i in range(n, -1, -1):
        here, below = rest[i], rest[i + 1] if i < n else {}
        for j in range(m, -1, -1):
            if not banded(i, j):
                continue
            if i == n and j == m:
                here[j] = 0
                continue
            best = none
            if i < n:
                best = below.get(j, none) + DELETE
                if j < m:
                    best = min(best, below.get(j + 1, none) + match(turns[i], target[j]))
            if j < m and target[j] != "s":
                best = min(best, here.get(j + 1, none) + INSERT)
            if best < none:
                here[j] = best
    cost = rest[0].get(0, none)
    if cost > bound or cost == none:
        return None
    audit, i, j = [], 0, 0
    while (i, j) != (n, m):  # D, I, K, R: the least letter that keeps the cost
        left = rest[i][j]
        if i < n and rest[i + 1].get(j, none) + DELETE == left:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and rest[i].get(j + 1, none) + INSERT == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return int(cost), "".join(audit)


def _passages(turns: str, entries: tuple[int, ...], ends: tuple[int, ...]) -> dict:
    """Per state before and state after a block of turns: the least cost and audit.

    Target lengths are tried by what their difference from the number of turns that may
    stay costs alone, until that is above the best so far of the state they end in. Twice
    the turns and two more are never worth it: to rename all that stay costs less.
    """
    stay = sum(t != "d" for t in turns)
    forced = DELETE * (len(turns) - stay)
    system = "s" in turns.lower()

    def least(length: int) -> int:
        return forced + (INSERT * (length - stay) if length > stay else DELETE * (stay - length))

    best: dict[tuple[int, int], tuple[int, str]] = {}
    for length in sorted(range(2 * stay + 3), key=least):
        for entry in entries:
            for target in _targets(entry, length):
                end = (entry, _AFTER[target[-1]] if target else entry)
                if end[1] not in ends or target[:1] == "s" and not system:
                    continue
                bound = best[end][0] if end in best else float("inf")
                found = _aligned(turns, target, bound) if least(length) <= bound else None
                if found and (end not in best or found < best[end]):
                    best[end] = found
    return best


def _joined(left: dict, right: dict) -> dict:
    """Passages through two blocks, one after the other."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for (entry, middle), (cost, audit) in left.items():
        for end in range(4):
            if (middle, end) in right:
                more, rest = right[middle, end]
                known = best.get((entry, end))
                if known is None or cost + more < known[0]:
                    best[entry, end] = (cost + more, audit + rest)
                elif cost + more == known[0]:
                    best[entry, end] = min(known, (cost + more, audit + rest))
    return best


_ANY = (START, SYSTEM, USER, ASSISTANT)


def _through(turns: str, entries: tuple[int, ...] = _ANY, ends: tuple[int, ...] = _ANY) -> dict:
    """Passages through all turns: halves are joined, so texts are copied log n times."""
    if len(turns) <= BLOCK:
        return _passages(turns, entries, ends)
    blocks = -(-len(turns) // BLOCK)
    cut = BLOCK * (blocks // 2)
    return _joined(_through(turns[:cut], entries), _through(turns[cut:], ends=ends))


@functools.lru_cache(maxsize=1 << 15)
def align(turns: str) -> tuple[int, str]:
    """The least cost and the least audit of that cost for a conversation."""
    return min(_through(turns, (START,), (START, ASSISTANT)).values())


# ------------------------------------------------------------------ whole tables


def prepared(conversations: DataFrame) -> DataFrame:
    """Nulls of role and text as one blank, each row said once."""
    return conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        F.lit(1).alias("copies"),
        *ROW,
    )


def _digest(text: str) -> Column:
    return F.unhex(F.md5(text))


def _equal(a: DataFrame, b: DataFrame, *columns: str) -> Column:
    """Equality of columns in which a null equals a null."""
    return functools.reduce(Column.__and__, [a[c].eqNullSafe(b[c]) for c in columns])


def _counted(rows: DataFrame) -> DataFrame:
    """Each turn, role and text of a conversation once, with its number and its faults.

    Texts stay behind, but for those that decide the order: of one turn and one role.
    ``mark`` names one of the rows that are equal.
    """
    end = F.rtrim(F.col("text"), F.lit(_BLANKS))
    keys = ["conv_id", "turn", "role", "digest", "blank", "cut"]
    turns = rows.select(
        "conv_id",
        "turn",
        "role",
        _digest("text").alias("digest"),
        (end == "").alias("blank"),
        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"),
        "copies",
        F.xxhash64(*ROW).alias("mark"),
    )
    turns = turns.groupBy(*keys).agg(
        F.sum("copies").alias("copies"), F.count("*").alias("rows"), F.min("mark").alias("mark")
    )
    turns = stage(turns, "turns")
    there = turns.filter("copies > 0")

    again = there.filter("NOT blank").groupBy("conv_id", "role", "digest")
    again = again.agg(
        F.count("*").alias("turns"), F.min("turn").alias("first"), F.bool_or(F.isnull("turn")).alias("unset")
    )
    again = stage(again.filter("turns > 1").drop("turns"), "again", plain=True)
    turns = turns.join(again, _equal(turns, again, "conv_id", "role", "digest"), "left").select(
        *[turns[c] for c in turns.columns],
        F.when(again["unset"], turns["turn"].isNotNull())
        .otherwise(F.coalesce(turns["turn"] > again["first"], F.lit(False)))
        .alias("earlier"),
    )

    tied = there.groupBy("conv_id", "turn", "role").count().filter("count > 1").drop("count")
    tied = stage(tied, "tied", plain=True)
    texts = rows.join(tied, _equal(rows, tied, "conv_id", "turn", "role"), "left_semi")
    texts = texts.select("conv_id", "turn", "role", _digest("text").alias("digest"), F.col("text").alias("tie"))
    texts = stage(texts.distinct(), "ties", plain=True)
    return turns.join(texts, _equal(turns, texts, "conv_id", "turn", "role", "digest"), "left").select(
        *[turns[c] for c in turns.columns], texts["tie"]
    )


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


_AUDIT = (
    "conv_id {}, gaps BIGINT, blank BIGINT, duplicate BIGINT, truncated BIGINT, illegal BIGINT, "
    "cost BIGINT, audit STRING, edits STRING"
)


def _audits(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its turns in order."""
    ready, size = [], 0
    for conv, turns in itertools.groupby(_streamed(batches), key=lambda row: row[0]):
        initials, shape, counts = [], [], []
        faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        low = high = None
        distinct = 0
        for _, turn, role, blank, cut, copies, earlier in turns:
            if not copies:
                continue
            if turn is not None and turn != high:
                low = turn if low is None else low
                high, distinct = turn, distinct + 1
            initial = role[:1]
            known = initial if initial and initial in "sua" else "x"
            fault = "blank" if blank else "duplicate" if earlier else "truncated" if cut else None
            if fault:
                faults[fault] += 1
            faults["blank" if blank else "duplicate"] += copies - 1
            initials.append(known * copies)
            first = "d" if blank or earlier else known.upper() if cut else known
            shape.append(first + "d" * (copies - 1))
            counts.append(copies)
        order = "".join(initials)
        cost, audit = align("".join(shape))
        gaps = 0 if low is None else high - low + 1 - distinct
        illegal = sum(order[i : i + 2] not in ("su", "ua", "au") for i in range(len(order) - 1))
        ready.append(
            (conv, gaps if gaps < 2**63 else None, *faults.values(), illegal, cost, audit, _once(audit, counts))
        )
        size += len(audit)
        if len(ready) >= 4096 or size > 1 << 24:
            yield _batch(ready, schema)
            ready, size = [], 0
    if ready:
        yield _batch(ready, schema)


def _once(audit: str, copies: list[int]) -> str:
    """The audit without the deletes of a turn's copies."""
    if all(n == 1 for n in copies):
        return audit
    kept, letters = [], iter(audit)
    for n in copies:
        seen = 0
        for letter in letters:
            if letter == "I" or not seen:
                kept.append(letter)
            seen += letter != "I"
            if seen == n:
                break
    return "".join(kept) + "".join(letters)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def audits(rows: DataFrame) -> DataFrame:
    """Per conversation: its faults, the cheapest cost and the audit of the edits.

    ``rows`` are those of ``prepared``; a row with 0 copies is absent but names its
    conversation. ``edits`` is the audit without the deletes of rows equal to the one before.
    """
    turns = _counted(rows)
    turns = (
        turns.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "tie")
        .select("conv_id", "turn", "role", "blank", "cut", "copies", "earlier")
    )
    declared = _AUDIT.format(rows.schema["conv_id"].dataType.simpleString())
    schema = _arrow(declared)
    return turns.mapInArrow(lambda batches: _audits(batches, schema), declared)


def _arrow(declared: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(declared))


def repaired(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """The turns of the repaired conversations, by (conv_id, place), with their edits.

    ``judged`` is the stored result of ``audits``. The turns of a conversation stand
    together, in order, in one partition.
    """
    there = rows.filter("copies > 0").withColumn("digest", _digest("text"))
    keys = ["conv_id", "turn", "role", "digest"]
    repeats = there.groupBy(*keys).agg(F.count("*").alias("rows"), F.min(F.xxhash64(*ROW)).alias("mark"))
    repeats = stage(repeats.filter("rows > 1"), "repeats", plain=True)
    texts = there.join(repeats, _equal(there, repeats, *keys), "left").filter(
        repeats["mark"].isNull() | (repeats["mark"] == F.xxhash64(*[there[c] for c in ROW]))
    )
    texts = texts.select(
        there["conv_id"], there["turn"], there["role"], there["text"], F.lit(None).cast("string").alias("edits")
    )
    nothing = F.lit(None)
    heads = judged.select(
        "conv_id",
        nothing.cast(rows.schema["turn"].dataType).alias("turn"),
        nothing.cast("string").alias("role"),
        nothing.cast("string").alias("text"),
        "edits",
    )
    both = (
        heads.union(texts)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("edits").isNull(), "turn", "role", "text")
        .select("conv_id", "turn", "role", "text", "edits")
    )
    key = rows.schema["conv_id"].dataType.simpleString()
    declared = f"conv_id {key}, place BIGINT, role STRING, text STRING, edit STRING"
    schema = _arrow(declared)
    return both.mapInArrow(lambda batches: _edited(batches, schema), declared)


def _edited(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    ready, size = [], 0
    edits, at, end, place, odd, last = "", 0, 0, 0, 0, None

    def role_at(place: int) -> str:
        return "ua"[(place - odd) % 2]

    def inserts(conv) -> Iterator[tuple]:
        nonlocal at, place
        while at < len(edits) and edits[at] == "I":
            yield (conv, place, _NAMES[role_at(place)], "", "I")
            at, place = at + 1, place + 1

    for conv, turn, role, text, head in _streamed(batches):
        if head is not None:
            edits, at, place, last = head, 0, 0, None
            odd = (len(edits) - edits.count("D")) % 2
            end = len(edits.rstrip("I"))  # inserts from here on follow the last turn
        elif (turn, role, text) != last:
            last = (turn, role, text)
            ready.extend(inserts(conv))
            edit = edits[at]
            at += 1
            if edit != "D":
                ready.append((conv, place, role if edit == "K" else _NAMES[role_at(place)], text, edit))
                place, size = place + 1, size + len(text)
            if at == end:
                ready.extend(inserts(conv))
        if len(ready) >= 4096 or size > 1 << 24:
            yield _batch(ready, schema)
            ready, size = [], 0
    if ready:
        yield _batch(ready, schema)


def _hashed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    ready = []
    for conv, turns in itertools.groupby(_streamed(batches), key=lambda row: row[0]):
        state = hashlib.sha256()
        for n, (_, role, text) in enumerate(turns):
            state.update(("\n" * (n > 0) + f"{role}:{text}").encode())
        ready.append((conv, state.hexdigest()))
        if len(ready) >= 4096:
            yield _batch(ready, schema)
            ready = []
    if ready:
        yield _batch(ready, schema)


def digests(turns: DataFrame) -> DataFrame:
    """SHA-256 of each repaired conversation's ``role:text`` lines, from ``repaired``.

    Turns stand in order in one partition, so nothing is shuffled; a digest is one pass
    over its turns by nature, and holds no more than a batch of them.
    """
    declared = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, repaired_sha256 STRING"
    schema = _arrow(declared)
    return turns.select("conv_id", "role", "text").mapInArrow(lambda b: _hashed(b, schema), declared)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audits and repaired turns of the conversations in ``prepared`` rows."""
    judged = stage(audits(rows), "audits")
    return judged, repaired(rows, judged)


def numbered_turns(conversations: DataFrame, stored: bool = False) -> DataFrame:
    """The columns used here and the place of each row; see ``shared.numbered``."""
    return numbered(conversations, "conv_id", "turn", "role", "text", stored=stored)


# ------------------------------------------------------------------ the query


def damaged(rows: DataFrame) -> DataFrame:
    """Prepared rows with the damage that the crc32 of ``conv_id:turn`` modulo 20 tells:
    0 drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 names a user."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key) % 20
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "")
        .when(kind == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
        *ROW,
    )


def audited(conversations: DataFrame, stored: bool = False) -> DataFrame:
    """Each conversation after damage: its faults, cost, audit and digest when repaired."""
    rows = damaged(prepared(numbered_turns(conversations, stored)))
    judged, turns = repair(rows)
    hashed = digests(turns)
    return judged.join(hashed, judged["conv_id"].eqNullSafe(hashed["conv_id"]), "left").select(
        *[judged[c] for c in judged.columns if c != "edits"],
        F.coalesce(hashed["repaired_sha256"], F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
