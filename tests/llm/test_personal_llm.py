"""Personal data: base patterns against plain expressions, the field against enumeration."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re

import pytest
from conftest import SMALL
from edge_cases import documents, stored

from rollbook.llm import personal

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text: str) -> list[tuple]:
    def digits(t):
        return re.sub("[^0-9]", "", t)

    def passes(number):
        doubled = [int(c) * (1 + n % 2) for n, c in enumerate(reversed(number))]
        return sum(v // 10 + v % 10 for v in doubled) % 10 == 0

    spans = [("email", *m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    spans += [
        ("card", *m.span())
        for m in CARD.finditer(text)
        if 16 <= len(digits(m.group())) <= 19 and passes(digits(m.group()))
    ]
    return spans + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]


def test_base_spans_equal_plain_expressions():
    draw = random.Random(3)
    for _ in range(20_000):
        text = "".join(draw.choices("0123456789" * 2 + "....@@a b-+()é\n", k=draw.randint(0, 40)))
        assert personal.base_spans(text) == brute_base(text), text
    long = "1" * 200_000 + "." + "2" * 200_000 + " a." * 50_000 + "@" * 1000 + "+1" + " 2" * 100_000
    assert personal.base_spans(long) == []


def segmentations(length, scored):
    """Every choice of segments that do not overlap."""
    for size in range(len(scored) + 1):
        for chosen in itertools.combinations(sorted(scored, key=lambda s: s[0][:2]), size):
            if all(a[0][1] <= b[0][0] for a, b in itertools.pairwise(chosen)):
                yield chosen


def value(chosen, step):
    total = sum(score for _, score in chosen)
    return total + sum(step(a[0][2], b[0][2]) for a, b in itertools.pairwise(chosen) if a[0][1] == b[0][0])


def test_decoding_and_expectations_equal_enumeration():
    draw = random.Random(8)
    for _ in range(60):
        length = draw.randint(1, 6)
        spots = [(i, j) for i in range(length) for j in range(i + 1, length + 1)]
        scored = [
            ((i, j, draw.choice(personal.KINDS), i, j), draw.uniform(-2, 3))
            for i, j in draw.sample(spots, min(len(spots), draw.randint(1, 8)))
        ]
        steps = {(a, b): draw.uniform(-1, 1) for a in personal.KINDS for b in personal.KINDS}

        def step(a, b, steps=steps):
            return steps[a, b] if a else 0.0

        ways = [(value(w, step), w) for w in segmentations(length, scored)]
        best = personal.best_segmentation(length, scored, step)
        assert value([(s, dict(scored)[s]) for s in best], step) == pytest.approx(max(w[0] for w in ways))
        total, odds, _ = personal.expectations(length, scored, step)
        assert total == pytest.approx(math.log(sum(math.exp(v) for v, _ in ways)))
        for one, odd in zip(scored, odds):
            share = sum(math.exp(v - total) for v, w in ways if one in w)
            assert odd == pytest.approx(share)


@pytest.fixture(scope="module")
def field(spark):
    return personal.fitted(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_held_out_spans_written_otherwise(field):
    """Spans of a kind the field never saw, rewritten, are found; look-alikes are not."""
    draw = random.Random(77)
    right = wrong = all_right = 0
    for n in range(150):
        card = "".join(str(draw.randint(0, 9)) for _ in range(15))
        card += next(str(d) for d in range(10) if personal.luhn(card + str(d)))
        spans = {
            "email": f"name{n}.x@host{n % 9}.example.com",
            "ip": ".".join(str(draw.randint(0, 255)) for _ in range(4)),
            "card": card,
            "phone": f"+1 ({draw.randint(100, 999)}) 555-{draw.randint(1000, 9999)}",
        }
        for kind, span in spans.items():
            for text, is_kind in personal.rewritten(kind, span, draw):
                found = personal.spans_of(f"words before {text} and after", field)[1]
                if is_kind:
                    all_right += 1
                    right += (kind, 13, 13 + len(text)) in found
                else:
                    wrong += found != brute_base(f"words before {text} and after")
    assert right >= 0.97 * all_right
    assert wrong <= 0.02 * all_right


@pytest.mark.parametrize(
    "text",
    [
        "on 2024-01-15 we met at 12:30:45",
        "paid 1,234,567.89 for version 1.2.3 of it",
        "see you at home. That is it, at work dot matrix printers",
        "isbn 978-3-16-148410-0 and 1/2 of 3-4",
        "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\"",
        "Plain words, nothing else.",
        "",
    ],
)
def test_clean_texts_stay_clean(field, text):
    assert personal.spans_of(text, field) == ([], [])


def test_a_pattern_that_swallows_two_spans(field):
    text = "ring +1 (826) 555-4081 190.137.223.204 now"
    base, spans = personal.spans_of(text, field)
    assert [(k, text[s:e]) for k, s, e in base] == [("ip", "190.137.223.204")]
    assert [(k, text[s:e]) for k, s, e in spans] == [("ip", "190.137.223.204"), ("phone", "+1 (826) 555-4081")]


def listed(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def test_report(spark, field, tmp_path):
    edges = stored(spark, documents(spark), tmp_path / "documents")
    for docs in (edges, spark.read.parquet(f"{SMALL}/documents.parquet")):
        texts = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=str)
        got = personal.reported(docs).collect()
        assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in texts)
        want = sorted(
            (str(i), *[sum(s[0] == k for s in brute_base(t)) for k in personal.KINDS],
             hashlib.sha256(listed(brute_base(t)).encode()).hexdigest())
            for i, t in texts
        )
        assert sorted((str(r[0]), *r[1:6]) for r in got) == want
        for r in got:
            spans = r.spans.split(",") if r.spans else []
            kinds = [personal.KINDS.index(s.split(":")[0]) for s in spans]
            assert kinds == sorted(kinds) and len(spans) >= sum(r[1:5])


def test_redacted(spark, field, tmp_path):
    rows = [(1, "Mail a.b@c.de or +1 (826) 555-4081.", "en", "a"), (None, None, None, None), (2, "", "en", "a")]
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING")
    got = {r.doc_id: r.text for r in personal.redacted(frame, field).collect()}
    assert got == {1: "Mail [email] or [phone].", None: None, 2: ""}


def test_empty_table(spark, tmp_path):
    nothing = stored(spark, documents(spark, []), tmp_path / "documents")
    assert personal.reported(nothing).collect() == []
    assert personal.fitted(nothing).weights == {}
