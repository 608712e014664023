"""Substring dedup: text units hashed, grouped over the corpus, kept once.

A unit is a line or, within it, a sentence: it ends at a line end, after a full stop,
exclamation or question mark before white space, and before a capital that follows white
space, so that a passage set into the middle of a sentence still makes units of its own. A unit of
more than LONG words is cut further, after words whose last character says so: where that
is follows from the words alone, so a passage is cut alike wherever it stands, and the ends
it loses to its surroundings are short.
Units are compared by a digest of their text in lower case with white space made single
blanks. The first place of a unit, by doc_id and then by the row's place, is kept. Other
places are marked, and marked units in a row that together have ``least`` words or more
are removed. Shorter repeats are what any two texts share, and stay.

Defined results: a null text stays null; null doc_ids rank last; equal rows are documents
of their own, of which the first keeps its text; repeats within a text count too. Spans
are in code points of the original text, end exclusive. Other columns are kept as they are.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.shared import ROW, numbered
from rollbook.sources.staging import stage

LEAST, LONG = 25, 20
_ALPHABETS = range(0x24, 0x3000)
_CAPITALS = "".join(chr(c) for c in _ALPHABETS if chr(c).isupper())
_BREAK = re.compile(rf"[ \t\r]*\n\s*|(?<=[.!?…])\s+|(?<=[。！？])(?!\s)|\s+(?=[{_CAPITALS}])")
#: The same for texts without full-width stops: a pattern that starts with white space is
#: looked for from blank to blank instead of at every character.
_BLANK_BREAK = re.compile(
    rf"\s(?:(?:(?<=\n)|(?<=[ \t\r])[ \t\r]*\n)\s*|(?<=[.!?…]\s)\s*|\s*(?=[{_CAPITALS}]))"
)
#: About a sixth of all words end in a character whose number is 4 above a multiple of 8.
_ENDS = "".join(re.escape(chr(c)) for c in _ALPHABETS if c % 8 == 4 and not chr(c).isspace())
_FINER = re.compile(rf"\s(?<=[{_ENDS}]\s)\s*")


def cuts(text: str) -> tuple[list[int], list[int]]:
    """Where the units of a text start and end."""
    starts, ends = [], []
    tail = len(text.rstrip())
    at = len(text) - len(text.lstrip())
    wide = "。" in text or "！" in text or "？" in text
    gaps = [g.span() for g in (_BREAK if wide else _BLANK_BREAK).finditer(text, at)]
    for gap, after in [*gaps, (tail, tail)]:
        if gap > at:
            # so many words have blanks between them
            if gap - at > 2 * LONG and len(text[at:gap].split()) > LONG:
                for finer in _FINER.finditer(text, at, gap):
                    starts.append(at)
                    ends.append(finer.start())
                    at = finer.end()
            starts.append(at)
            ends.append(gap)
        at = after
    return starts, ends


def units(text: str) -> tuple[list[int], list[int], list[int]]:
    """Where the units of a text start and end, and how many words each has."""
    starts, ends = cuts(text)
    return starts, ends, [len(text[a:b].split()) for a, b in zip(starts, ends, strict=True)]


def digests(text: str, starts: list[int], ends: list[int]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    lowered = text.lower()
    if len(lowered) == len(text) and not ("  " in text or "\t" in text or "\r" in text):
        made = [digest(lowered[a:b]) for a, b in zip(starts, ends, strict=True)]
    else:
        made = []
        for a, b in zip(starts, ends, strict=True):
            unit = text[a:b].lower()
            if "  " in unit or "\t" in unit or "\r" in unit:
                unit = " ".join(unit.split())
            made.append(digest(unit))
    return np.array(made, dtype=np.uint64).view(np.int64)


def _first_seen(digest: np.ndarray) -> np.ndarray:
    """Which units of a text are not repeats of earlier ones in it."""
    first = np.zeros(len(digest), dtype=bool)
    first[np.unique(digest, return_index=True)[1]] = True
    return first


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (digest, doc_id, ROW, unit) for the units of texts, repeats within one left out."""
    for whole in batches:
        for at in range(0, len(whole), 1000):
            batch = whole.slice(at, 1000)
            owners, numbers, found = [], [], []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                digest = digests(text, *cuts(text))
                number = np.flatnonzero(_first_seen(digest))
                owners.append(np.full(len(number), i))
                numbers.append(number)
                found.append(digest[number])
            if not found:
                continue
            owner = pa.array(np.concatenate(owners))
            columns = [
                pa.array(np.concatenate(found)),
                *batch.select(["doc_id", *ROW]).take(owner).columns,
                pa.array(np.concatenate(numbers).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "doc_id", *ROW, "unit"])


def spans(text: str, marked: list[int], least: int) -> list[tuple[int, int]]:
    """What to remove from a text whose units ``marked`` have an earlier place elsewhere."""
    starts, ends = cuts(text)
    repeat = ~_first_seen(digests(text, starts, ends))
    repeat[marked] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], repeat.astype(np.int8), [0]])))
    found = []
    for a, b in edge.reshape(-1, 2):
        words = sum(len(text[c:d].split()) for c, d in zip(starts[a:b], ends[a:b], strict=True))
        if words >= least:
            found.append((starts[a], starts[b] if b < len(starts) else len(text)))
    return found


def _cleaner(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for text, marked in zip(batch.column("text"), batch.column("_units"), strict=True):
                text, marked = text.as_py(), marked.as_py() or []
                cut = spans(text, marked, least) if text else []
                kept, at = [], 0
                for a, b in cut:
                    kept.append(text[at:a])
                    at = b
                texts.append(text if not cut else "".join([*kept, text[at:]]))
                removed.append([{"start": a, "end": b} for a, b in cut])
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {
                "text": pa.array(texts, pa.string()),
                "_removed": pa.array(
                    removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                ),
            }
            del columns["_units"]
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def deduplicated(docs: DataFrame, least: int = LEAST, stored: bool = False) -> DataFrame:
    """The rows of ``docs`` with repeats cut out of text, and the spans cut as ``_removed``."""
    if not stored:
        docs = stage(docs, "documents")
    last = F.lit(2**63 - 1)
    rows = numbered(docs, "doc_id", "text", stored=True)
    ranked = rows.select(
        F.coalesce(F.col("doc_id").cast("bigint"), last).alias("doc_id"), *ROW, "text"
    )
    listed = ranked.mapInArrow(
        _listed, "digest bigint, doc_id bigint, row_file bigint, row_index bigint, unit int"
    )
    place = F.col(ROW[0]).bitwiseXOR(F.col(ROW[1]))
    firsts = listed.groupBy("digest").agg(
        F.count("*").alias("many"),
        F.min("doc_id").alias("first_doc"),
        F.min_by(place, F.col("doc_id")).alias("first_place"),
    )
    # kept in files: of rows with one doc_id any may come first, but the same one for all
    firsts = stage(firsts.filter("many > 1").drop("many"), "firsts")
    later = listed.join(firsts, "digest").filter(
        (F.col("doc_id") != F.col("first_doc")) | (place != F.col("first_place"))
    )
    marked = later.groupBy(*ROW).agg(F.collect_list("unit").alias("_units"))
    marked = marked.select(*[F.col(c).alias(f"_{c}") for c in ROW], "_units")
    meta = docs.metadataColumn("_metadata")
    same = (F.xxhash64(meta["file_path"]) == F.col("_row_file")) & (
        meta["row_index"] == F.col("_row_index")
    )
    told = docs.join(marked, same, "left").select(*[docs[c] for c in docs.columns], "_units")
    removed = T.ArrayType(
        T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    )
    out = T.StructType([*docs.schema.fields, T.StructField("_removed", removed)])
    return told.mapInArrow(_cleaner(least), out)


def cleaned(docs: DataFrame, least: int = LEAST, stored: bool = False) -> DataFrame:
    """The documents without repeats, in the columns of ``docs``; n_chars counts anew."""
    out = deduplicated(docs, least, stored).drop("_removed")
    if "n_chars" in out.columns:
        kind = out.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))
    return out


def removals(docs: DataFrame, least: int = LEAST, stored: bool = False) -> DataFrame:
    """Per document: doc_id, text without repeats, removed spans and how long both are."""
    done = deduplicated(docs.select("doc_id", "text"), least, stored)
    return done.select(
        "doc_id",
        "text",
        F.col("_removed").alias("removed"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("kept_chars"),
        F.aggregate(
            "_removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]
        ).alias("removed_chars"),
    )
