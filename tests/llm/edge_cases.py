"""Tables with nulls, empty and very long texts, repeated rows and clashing columns."""

from __future__ import annotations

import random

EXTRA = "size BIGINT, rank STRING, chunk INT, row_index BIGINT, row_file STRING, kept BOOLEAN, bucket INT"
_DOCUMENT = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
_REST = (7, "x", None, 3, "f", True, None)


def prose(seed: int, count: int) -> str:
    draw = random.Random(seed)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(2, 7))) for _ in range(count)]
    text = ""
    for n, word in enumerate(words):
        text += word.capitalize() if n % 9 == 0 else word
        text += ".\n" if n % 27 == 26 else ". " if n % 9 == 8 else " "
    return text.strip()


def document_rows() -> list[tuple]:
    base = prose(1, 300)
    near = base.replace(base.split()[40], "other", 1)
    passage = prose(2, 60) + "."
    rows = [
        (1, base, "en", "a"),
        (2, near, "en", "b"),
        (3, base, "de", "a"),
        (3, base, "de", "a"),  # the same row twice
        (4, None, "en", "a"),
        (5, "", None, None),
        (None, prose(3, 80), None, None),
        (None, prose(3, 80), None, None),
        (6, " \t\n", "en", ""),
        (7, "one two", "fr", "c"),
        (8, prose(4, 50_000), "fr", "c"),
        (9, prose(5, 30) + " " + passage + " " + prose(6, 30), "en", None),
        (10, prose(7, 40) + " " + passage + " " + prose(8, 20), "en", "b"),
        (11, "é " * 40, None, "é"),
        (12, "<|endoftext|> it's x'll\x0b\x1cy", "en", "z"),
    ]
    return [(i, t, lang, s, len(t or ""), *_REST) for i, t, lang, s in rows]


def documents(spark, rows=None):
    data = document_rows() if rows is None else rows
    return spark.createDataFrame(data, f"{_DOCUMENT}, {EXTRA}")


def stored(spark, frame, path):
    frame.repartition(3).write.parquet(str(path))
    return spark.read.parquet(str(path))
