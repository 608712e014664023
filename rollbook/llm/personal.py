"""Personal data by patterns, and what patterns miss by a semi-Markov random field.

Base spans follow fixed patterns: e-mail addresses, IP addresses, card numbers that pass
Luhn, phone numbers with a plus. They always stay. A semi-Markov conditional random field
adds spans written otherwise ("name at host dot com", 0170 555 77 13, 10[.]0[.]0[.]1,
cards in other groups): whole-span features score each candidate segment of a kind,
outside tokens score nothing, and bounded-entity dynamic programming over a zone chooses
boundaries and kinds jointly. Segments hold at most ``LONGEST`` tokens. Text outside the
zones holds no candidate, so leaving it out changes no optimum.

The field is trained here by conditional likelihood on windows around the base spans of at
most about ``sample`` documents (chosen by a hash of the text, for training alone), on the
same spans written in other ways, and on numbers that are none. Decoding reads every whole
text of every row; a row's work does not depend on other rows.

Defined results: null and empty texts have no spans. Kinds may overlap among base spans;
an added span overlaps none. Equal rows have equal results. Without rows to learn from,
nothing is added. Other columns are left out, whatever their names.
"""

from __future__ import annotations

import dataclasses
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.sources.staging import stage

KINDS = ("email", "ip", "card", "phone")

# Patterns fixed by the contract. Looking back, and possessive runs, only spare starts
# that would fail in the same place.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

LONGEST = 8  # tokens of a segment
WINDOW = 30  # characters on each side that a training window keeps
SAMPLE = 8_000
PER_KIND = 120  # training windows of a kind

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = int(d) * (1 + n % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCALS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind as listed, then by start."""
    spans = [("email", s, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        parts = m.group().split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() <= 64 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                spans.append(("phone", *m.span()))
    return spans


# ------------------------------------------------------------------ zones and segments

#: How "@" and "." are written out; fixed values.
_AT = r"(?:\x20?[\[({]\x20?(?:at|AT|@|arroba)\x20?[\])}]\x20?|\x20(?:at|AT|arroba)\x20)"
_DOT = r"(?:\x20?[\[({]\x20?(?:dot|DOT|\.|punto|punkt|point)\x20?[\])}]\x20?|\x20(?:dot|DOT|punto|punkt|point)\x20|\.)"
_NAME = r"[A-Za-z0-9_%+-]++"
_WRITTEN = re.compile(rf"(?<![A-Za-z0-9_%+-]){_NAME}(?:{_DOT}{_NAME}){{0,5}}?(?:{_AT}|@){_NAME}(?:{_DOT}{_NAME})+")
_HINT = re.compile(_AT)
_PART = re.compile(_NAME)
_GROUP = re.compile(r"[0-9]+")
#: Between the groups of one number: up to three characters, none a letter, digit or line end.
_BETWEEN = re.compile(r"[\x20\xa0().\[\]{}/+_-]{1,3}")


@dataclasses.dataclass
class Zone:
    """Tokens of a stretch of text and the segments that may be entities there."""

    tokens: list[tuple[int, int]]
    segments: list[tuple[int, int, str, int, int]]  # first token, after the last, kind, characters


def _number_zone(text: str, groups: list[tuple[int, int]]) -> Zone | None:
    segments = []
    sizes = [e - s for s, e in groups]
    for i in range(len(groups)):
        count = 0
        for j in range(i, min(len(groups), i + LONGEST)):
            count += sizes[j]
            if count > 19:
                break
            start, end = groups[i][0], groups[j][1]
            if start and text[start - 1] in "+(":
                start -= 1
                if text[start] == "(" and text[start - 1 : start] == "+":
                    start -= 1
            if j - i == 3 and max(sizes[i : j + 1]) <= 3:
                segments.append((i, j + 1, "ip", start if text[start] != "+" else groups[i][0], end))
            if count >= 16 and (j > i or count > 16):
                segments.append((i, j + 1, "card", groups[i][0], end))
            if 8 <= count <= 15 and j > i or 9 <= count <= 15:
                segments.append((i, j + 1, "phone", start, end))
    return Zone(groups, segments) if segments else None


def _address_zone(text: str, start: int, end: int) -> Zone | None:
    parts = [(start + m.start(), start + m.end()) for m in _PART.finditer(text[start:end])]
    mark = next(m for m in re.finditer(rf"{_AT}|@", text[start:end]))
    parts = [p for p in parts if not (start + mark.start() <= p[0] and p[1] <= start + mark.end())]
    dots = [(start + m.start(), start + m.end()) for m in re.finditer(_DOT, text[start:end])]
    parts = [p for p in parts if not any(s <= p[0] and p[1] <= e for s, e in dots)]
    local = sum(p[1] <= start + mark.start() for p in parts)
    segments = [
        (i, j, "email", parts[i][0], parts[j - 1][1])
        for i in range(local)
        for j in range(local + 2, min(len(parts), i + LONGEST) + 1)
    ]
    return Zone(parts, segments) if segments else None


def zones(text: str, taken: list[Span]) -> Iterator[Zone]:
    """Stretches with candidate segments; none overlaps a span that is taken."""
    walls = sorted((s, e) for _, s, e in taken)
    at = 0

    def free(start: int, end: int) -> bool:
        nonlocal at
        while at < len(walls) and walls[at][1] <= start:
            at += 1
        return at == len(walls) or walls[at][0] >= end

    groups: list[tuple[int, int]] = []
    for m in _GROUP.finditer(text):
        start, end = m.span()
        if end - start > 19 or not free(start, end):
            zone, groups = groups, []
        elif groups and not _BETWEEN.fullmatch(text, groups[-1][1], start):
            zone, groups = groups, [(start, end)]
        else:
            zone = []
            groups.append((start, end))
        if zone and (found := _number_zone(text, zone)):
            yield found
    if groups and (found := _number_zone(text, groups)):
        yield found
    if _HINT.search(text):
        at = 0
        for m in _WRITTEN.finditer(text):
            if free(*m.span()) and (found := _address_zone(text, *m.span())):
                yield found


# ------------------------------------------------------------------ whole-span features

#: Words before a number or an address, and endings of domains; fixed values.
_CUES = {
    "email": ("mail", "email", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "karte", "tarjeta", "carte"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "telefon", "handy"),
}
_ENDINGS = frozenset("com org net edu gov de fr es it uk eu io info biz".split())
_CUE = re.compile(r"([^\W\d_]+)[.:\s]{0,3}$")


def _near(char: str) -> str:
    if not char or char.isspace():
        return "blank"
    if char.isalpha() or char == "_":
        return "letter"
    if char.isdigit():
        return "digit"
    return char if char in "+-./=\"'#$%&:,;()[]" else "other"


def features(text: str, kind: str, start: int, end: int) -> list[str]:
    """What is seen of a whole segment, its shape and its surroundings."""
    span = text[start:end]
    seen = [
        "is",
        "before " + _near(text[start - 1 : start]),
        "after " + _near(text[end : end + 1]),
    ]
    if text[end : end + 1] in (".", ",") and text[end + 1 : end + 2].isalnum():
        seen.append("goes on")
    cue = _CUE.search(text, max(0, start - 24), start)
    if cue and cue.group(1).lower() in _CUES[kind]:
        seen.append("cue")
    if kind == "email":
        labels = _PART.findall(span)
        at = re.search(_AT, span)
        seen += [
            "at " + ("@" if not at else "bracket" if any(c in at.group() for c in "[({") else "word"),
            "dot " + ("written" if re.search(r"dot|DOT|punto|punkt|point|[\[({]", span) else "plain"),
            "ending " + ("known" if labels[-1].lower() in _ENDINGS else "short" if len(labels[-1]) <= 4 else "long"),
            "local " + ("number" if any(c.isdigit() for c in span[: at.start() if at else 1]) else "word"),
            f"labels {min(len(labels), 6)}",
        ]
    else:
        groups = _GROUP.findall(span)
        digits = "".join(groups)
        marks = "".join(sorted(set(re.sub(r"[0-9]", "", span))))
        seen += [
            f"digits {len(digits)}",
            f"groups {len(groups)}",
            "marks " + marks,
            "sizes " + "-".join(str(len(g)) for g in groups),
            "head " + (span[0] if span[0] in "+(" else "zero" if span[0] == "0" else "digit"),
        ]
        if kind == "ip":
            seen.append("bytes" if all(int(g) <= 255 for g in groups) else "no bytes")
        if kind == "card":
            seen.append("luhn" if luhn(digits) else "no luhn")
        if kind == "phone" and len(groups) == 3 and re.search(r"(19|20)\d\d", " ".join(groups)):
            seen.append("date")
    return [f"{kind}|{s}" for s in seen]


# ------------------------------------------------------------------ the field


@dataclasses.dataclass(frozen=True)
class Field:
    """Weights of features, and of a kind that follows a kind without a gap."""

    weights: dict[str, float]

    def score(self, text: str, segment: tuple) -> float:
        _, _, kind, start, end = segment
        return sum(self.weights.get(f, 0.0) for f in features(text, kind, start, end))

    def step(self, left: str | None, right: str) -> float:
        return self.weights.get(f"{left}>{right}", 0.0) if left else 0.0

    def decode(self, text: str, zone: Zone) -> list[Span]:
        """The best segmentation of a zone; outside tokens are chosen on equal scores."""
        scored = [(s, self.score(text, s)) for s in zone.segments]
        return [(k, s, e) for _, _, k, s, e in best_segmentation(len(zone.tokens), scored, self.step)]


def best_segmentation(length: int, scored: list[tuple[tuple, float]], step) -> list[tuple]:
    """Bounded-entity dynamic programming: per token and last kind the best score."""
    ending: dict[int, list] = {}
    for segment, score in scored:
        ending.setdefault(segment[1], []).append((segment, score))
    best: list[dict] = [{None: (0.0, None, None)}]  # kind -> score, segment, kind before it
    for at in range(1, length + 1):
        last = max(best[at - 1].items(), key=lambda item: item[1][0])
        here = {None: (last[1][0], None, last[0])}
        for segment, score in ending.get(at, ()):
            kind = segment[2]
            for before, (total, _, _) in best[segment[0]].items():
                total += score + step(before, kind)
                if kind not in here or total > here[kind][0]:
                    here[kind] = (total, segment, before)
        best.append(here)
    kind, at, chosen = max(best[-1].items(), key=lambda item: item[1][0])[0], length, []
    while at:
        _, segment, before = best[at][kind]
        if segment:
            chosen.append(segment)
        at, kind = (segment[0] if segment else at - 1), before
    return chosen[::-1]


def _logadd(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def expectations(length: int, scored: list[tuple[tuple, float]], step) -> tuple[float, list[float], dict]:
    """The log of the sum over all segmentations, and the odds of segments and steps."""
    starting: dict[int, list[int]] = {}
    ending: dict[int, list[int]] = {}
    for n, (segment, _) in enumerate(scored):
        starting.setdefault(segment[0], []).append(n)
        ending.setdefault(segment[1], []).append(n)
    forth: list[dict] = [{None: 0.0}]
    for at in range(1, length + 1):
        sums = {None: [_logadd(list(forth[at - 1].values()))]}
        for n in ending.get(at, ()):
            (i, _, kind, *_), score = scored[n]
            sums.setdefault(kind, []).extend(v + step(k, kind) + score for k, v in forth[i].items())
        forth.append({k: _logadd(v) for k, v in sums.items()})
    back: list[dict] = [{} for _ in range(length + 1)]
    back[length] = dict.fromkeys((None, *KINDS), 0.0)
    for at in range(length - 1, -1, -1):
        ways = [(None, back[at + 1][None])]
        ways += [(scored[n][0][2], scored[n][1] + back[scored[n][0][1]][scored[n][0][2]]) for n in starting.get(at, ())]
        for kind in (None, *KINDS):
            back[at][kind] = _logadd([v + (step(kind, k) if k else 0.0) for k, v in ways])
    total = _logadd(list(forth[-1].values()))
    odds, steps = [], {}
    for (i, j, kind, *_), score in scored:
        odd = 0.0
        for before, value in forth[i].items():
            p = math.exp(value + step(before, kind) + score + back[j][kind] - total)
            odd += p
            if before:
                steps[f"{before}>{kind}"] = steps.get(f"{before}>{kind}", 0.0) + p
        odds.append(odd)
    return total, odds, steps


def train(examples: list[tuple[str, list[Span]]], rounds: int = 40, rate: float = 0.5, decay: float = 0.02) -> Field:
    """Weights by conditional likelihood of the labelled texts, by adaptive gradient steps.

    An example whose spans are no candidates is left out: it could not be decoded.
    """
    names: dict[str, int] = {}
    cases = []
    for text, gold in examples:
        for zone in zones(text, []):
            if not all(any(s[2:] == g for s in zone.segments) or not _inside(zone, g) for g in gold):
                continue
            rows = [
                np.array([names.setdefault(f, len(names)) for f in features(text, s[2], s[3], s[4])])
                for s in zone.segments
            ]
            cases.append((zone, rows, [s[2:] in gold for s in zone.segments]))
    if not cases:
        return Field({})
    for a in KINDS:
        for b in KINDS:
            names.setdefault(f"{a}>{b}", len(names))
    weights, squares = np.zeros(len(names)), np.full(len(names), 1e-8)

    def step(left: str | None, right: str) -> float:
        return weights[names[f"{left}>{right}"]] if left else 0.0

    for _ in range(rounds):
        gradient = -decay * weights
        for zone, rows, gold in cases:
            scored = [(s, float(weights[r].sum())) for s, r in zip(zone.segments, rows)]
            _, odds, steps = expectations(len(zone.tokens), scored, step)
            for row, odd, right in zip(rows, odds, gold):
                np.add.at(gradient, row, right - odd)
            for name, odd in steps.items():
                gradient[names[name]] -= odd
        squares += gradient**2
        weights = weights + rate * gradient / np.sqrt(squares)
    return Field({name: float(weights[n]) for name, n in names.items()})


def _inside(zone: Zone, span: Span) -> bool:
    return zone.tokens[0][0] < span[2] and span[1] < zone.tokens[-1][1]


# ------------------------------------------------------------------ training windows


def windows(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, text, start, end) around each base span, and around numbers that are none."""
    found = base_spans(text)
    for kind, start, end in found:
        low = max(0, start - WINDOW)
        yield kind, text[low : end + WINDOW], start - low, end - low
    for zone in zones(text, found):
        start, end = zone.tokens[0][0], zone.tokens[-1][1]
        if end - start <= 200:
            low = max(0, start - WINDOW)
            yield "none", text[low : end + WINDOW], 0, 0


def _spread(digits: str, sizes: list[int], mark: str) -> str:
    parts, at = [], 0
    for n in sizes:
        parts.append(digits[at : at + n])
        at += n
    return mark.join(p for p in [*parts, digits[at:]] if p)


def rewritten(kind: str, span: str, draw: random.Random) -> list[tuple[str, bool]]:
    """The span in other ways, and look-alikes that are none of its kind."""
    digits = _digits(span)
    if kind == "email":
        name, _, host = span.partition("@")
        at = draw.choice([" at ", " (at) ", "(at)", "[at]", " [at] ", " AT ", "(@)"])
        dot = draw.choice([" dot ", "(dot)", "[dot]", " (dot) ", "[.]", " DOT ", "."])
        return [
            (name + at + host.replace(".", dot), True),
            (name.split(".")[0] + " at " + host.split(".")[0] + "." + draw.choice(["Then", "It", "That"]), False),
        ]
    if kind == "ip":
        mark = draw.choice(["[.]", "(.)", " . "])
        parts = span.split(".")
        wrong = [str(int(p) + 300) if n == 0 else p for n, p in enumerate(parts)]
        return [(mark.join(parts), True), (".".join(wrong), False), (draw.choice(["-", "/", " "]).join(parts), False)]
    if kind == "card":
        mark = draw.choice([".", " - ", "  ", "/", "\xa0", "_"])
        last = str((int(digits[-1]) + draw.randint(1, 9)) % 10)
        wrong = digits[:-1] + last
        return [
            (_spread(digits, [4, 4, 4], mark), True),
            (_spread(wrong, [4, 4, 4], mark), False),
            (wrong, False),
            (_spread(wrong, [4, 4, 4], draw.choice([" ", "-"])), False),
        ]
    area, rest = digits[-10:-7], digits[-7:]
    day, month, year = draw.randint(1, 28), draw.randint(1, 12), draw.randint(1950, 2030)
    return [
        (draw.choice([f"({area}) {rest[:3]}-{rest[3:]}", f"{area}-{rest[:3]}-{rest[3:]}"]), True),
        (draw.choice([f"{area}.{rest[:3]}.{rest[3:]}", f"0{area} {rest[:3]} {rest[3:]}", f"0{area}/{rest}"]), True),
        (draw.choice([f"001 {area} {rest[:3]} {rest[3:]}", f"1-{area}-{rest[:3]}-{rest[3:]}"]), True),
        (draw.choice([f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{day:02}/{month:02}/{year}"]), False),
        (draw.choice([f"{digits[:1]},{digits[1:4]},{digits[4:7]}", digits[:10], f"978-{digits[0]}-{digits[1:3]}-{digits[3:9]}-{digits[-1]}"]), False),
    ]


def examples(rows: list[tuple[str, str, int, int]]) -> list[tuple[str, list[Span]]]:
    """Labelled texts from windows: as they stand and rewritten."""
    made: list[tuple[str, list[Span]]] = []
    for kind, text, start, end in rows:
        if kind == "none":
            made.append((text, base_spans(text)))
            continue
        made.append((text, base_spans(text)))
        draw = random.Random(f"{kind} {text[start:end]}")
        head, tail = text[:start].rstrip("0123456789+(.@"), text[end:].lstrip("0123456789)-.@")
        for span, right in rewritten(kind, text[start:end], draw):
            new = head + span + tail
            gold = [(kind, len(head), len(head) + len(span))] if right else []
            made.append((new, gold + [s for s in base_spans(new) if not _meets(s, gold)]))
    return made


def _meets(span: Span, others: list[Span]) -> bool:
    return any(span[1] < e and s < span[2] for _, s, e in others)


# ------------------------------------------------------------------ whole tables


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Small slices of the batches, the last column as Python texts."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            yield part, part.column(part.num_columns - 1).to_pylist()


_WINDOW = pa.schema([("kind", pa.string()), ("window", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in _texts(batches):
        rows = [dict(zip(_WINDOW.names, w)) for text in texts for w in windows(text)]
        yield pa.RecordBatch.from_pylist(rows, schema=_WINDOW)


def fitted(documents: DataFrame, sample: int = SAMPLE) -> Field:
    """The field learnt from about ``sample`` documents, chosen by a hash of their text."""
    every = max(1, documents.count() // sample)
    chosen = documents.filter((F.pmod(F.xxhash64("text"), F.lit(every)) == 0) & F.col("text").rlike("[0-9]"))
    seen = chosen.select("text").mapInArrow(_windows, "kind STRING, window STRING, start INT, end INT")
    seen = stage(seen.distinct().withColumn("at", F.xxhash64("window", "start")), "windows")
    rows = []
    for kind in (*KINDS, "none"):
        least = seen.filter(F.col("kind") == kind).orderBy("at", "window", "start", "end").limit(PER_KIND)
        rows += [(r.kind, r.window, r.start, r.end) for r in least.collect()]
    return train(examples(rows))


def spans_of(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text, both by kind as listed, then by start."""
    base = base_spans(text or "")
    more = [s for zone in zones(text or "", base) for s in field.decode(text, zone)]
    if not more:
        return base, base
    clear = []
    for span in sorted(more, key=lambda s: (s[1], s[2])):  # zones of numbers and of addresses may meet
        if not clear or span[1] >= clear[-1][2]:
            clear.append(span)
    return base, sorted(base + clear, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _structs(lists: list[list[Span]]) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans] for spans in lists], type=_SPANS)


def found(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """Per row: doc_id, its base spans and all spans, in code points, end exclusive."""
    field = field or fitted(documents)
    span = "ARRAY<STRUCT<kind: STRING, start: BIGINT, end: BIGINT>>"
    key = documents.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            base, spans = zip(*(spans_of(text, field) for text in texts))
            arrays = [part.column(0), _structs(base), _structs(spans)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "base", "spans"])

    return documents.select("doc_id", "text").mapInArrow(search, f"doc_id {key}, base {span}, spans {span}")


def covered(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of spans that overlap the first names all."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redacted(documents: DataFrame, field: Field | None = None) -> DataFrame:
    """Per row: doc_id and its text with each span replaced by its kind in brackets."""
    field = field or fitted(documents)
    key = documents.schema["doc_id"].dataType.simpleString()

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            clean = [None if t is None else covered(t, spans_of(t, field)[1]) for t in texts]
            arrays = [part.column(0), pa.array(clean, type=pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text"])

    return documents.select("doc_id", "text").mapInArrow(replace, f"doc_id {key}, text STRING")


def reported(documents: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans as text."""

    def joined(column: str) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found(documents).select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
    )
