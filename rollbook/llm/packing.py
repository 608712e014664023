"""Best-fit packing of documents into sequences, planned over a histogram of lengths.

Documents become pieces of at most ``size`` tokens. How many pieces there are of each
length is all that the plan needs: at most ``size`` counts, whatever the corpus holds.
Best fit, longest first, then places whole runs of equal pieces into whole runs of
equal sequences, and each piece takes the place that the plan gives to its rank among
the pieces of its length.

Defined results: a null text is an empty one, and an empty one is the end mark alone;
documents of more than ``size`` tokens with their end mark, and only those, are cut;
equal rows are documents of their own; an empty table gives no rows. Besides text and
doc_id no column is read.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import ROW, chunks_for, numbered, running
from rollbook.sources.staging import stage

END = (0).to_bytes(4, "little")
PIECES = (
    "row_file bigint, row_index bigint, doc_id bigint, piece int, start bigint, length bigint,"
    " ids_crc32 bigint"
)
PLAN = (
    "_length bigint, first_rank bigint, end_rank bigint, per_sequence bigint, sequence bigint,"
    " place bigint"
)


# Letters, digits and marks of which the tokenizer's pattern makes pieces one by one:
# no apostrophe (it opens contractions) and nothing that combines with its neighbours.
_LETTERS = "a-z\xdf-\xf6\xf8-\xff"
_MARKS = r"!-&(-/:-@\[-`{-~"
_PIECE = re.compile(f"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")
_PLAIN = re.compile(f"[A-Z\xc0-\xd6\xd8-\xde{_LETTERS}0-9{_MARKS} \n]*")


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit numbers.

    The tokenizer splits a text into pieces and codes each on its own, and no piece
    holds white space. So the ids of a plain text, one of the characters above, are those
    of its runs of letters or marks and its single digits, one after another; and those of
    any other text are those of what stands between its blanks and line ends. Ids of pieces
    and of short words are kept, as many as fit the bounds.
    """

    def __init__(self, path: str, most_words: int = 100_000, most_pieces: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a process per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most_words, self.most_pieces = most_words, most_pieces
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)  # a piece's last token
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def __call__(self, text: str) -> bytes:
        if "<|" not in text and _PLAIN.fullmatch(text) is not None:
            pieces = _PIECE.findall(text.lower())
            return self._known(pieces, self.pieces, self.coded_plain, self.most_pieces)
        words = text.replace("\n", " ").split(" ")
        return self._known(words, self.words, self.coded, self.most_words)

    def _known(self, parts: list[str], known: dict[str, bytes], code: Callable, most: int) -> bytes:
        """The ids of the parts; new ones are coded together."""
        if len(known) > most:
            known.clear()
        new = list(itertools.filterfalse(known.__contains__, set(parts)))
        if new:
            known |= zip(new, code(new), strict=True)
        ids = b"".join(map(known.__getitem__, parts))
        for part in new:
            if len(part) > 32:
                del known[part]
        return ids

    def coded(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def coded_plain(self, pieces: list[str]) -> Iterator[bytes]:
        found = self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0]
        ids = np.array(found.ids, dtype="<u4")
        bounds = [0, *(4 * np.flatnonzero(self.last[ids]) + 4).tolist()]
        return map(ids.tobytes().__getitem__, map(slice, bounds, bounds[1:]))


@cache
def encoder(path: str) -> Encoder:
    """One for each Python process: what it has learnt serves the next task too."""
    return Encoder(path)


def cutter(path: str, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows of PIECES for rows of (ROW, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            owner, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = encode(text.as_py() or "") + END
                for n, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    owner.append(i)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            kept = batch.select([*ROW, "doc_id"]).take(pa.array(owner, pa.int64()))
            made = (
                pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, length, crc)),
            )
            names = [*ROW, "doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=names)

    return run


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, stored: bool = False) -> DataFrame:
    """One row per piece of a document; ``tokenizer`` is the path of its file."""
    rows = numbered(docs, "doc_id", "text", stored=stored)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.select(*ROW, "doc_id", "text").mapInArrow(cutter(tokenizer, size), PIECES)


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Places for ``counts`` pieces of each length, as rows of PLAN.

    Runs of sequences with the same room left are filled together: the tightest run
    that a length fits takes as many of it as go in, sequence after sequence, which is
    what best fit does piece by piece. A run that is filled keeps less than half of its
    room, and a length splits one run at most: so there are fewer than 4 * size runs,
    each in at most log2(size) rows.
    """
    plan, made = [], 0
    runs: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, how many)
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = min((r for r in runs if r >= length), default=None)
            if room is None:
                room = size
                first, many = made, -(-left // (room // length))
                made += many
            else:
                first, many = runs[room].pop()
                if not runs[room]:
                    del runs[room]
            fit = room // length
            full = min(many, left // fit)
            parts = [(full, fit)] if full else []
            if full < many and left % fit and left // fit == full:
                parts.append((1, left % fit))
            for n, each in parts:
                plan.append((length, rank, rank + n * each, each, first, size - room))
                if room - each * length:
                    runs.setdefault(room - each * length, []).append((first, n))
                rank += n * each
                left -= n * each
                first += n
                many -= n
            if many:
                runs.setdefault(room, []).append((first, many))
    return plan


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, stored: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    cut = stage(pieces(docs, tokenizer, size, stored), "pieces")
    histogram = cut.groupBy("length").count().collect()  # at most ``size`` rows
    counts = {row["length"]: row["count"] for row in histogram}
    plan = cut.sparkSession.createDataFrame(best_fit(counts, size), PLAN)

    chunk = F.pmod(F.xxhash64(*ROW), F.lit(chunks_for(sum(counts.values()))))
    ranked = running(
        cut.withColumn("chunk", chunk), ["length"], "chunk", [*ROW, "piece"], F.lit(1), "rank"
    )
    here = (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("first_rank"))
    placed = ranked.join(F.broadcast(plan), here & (F.col("rank") < F.col("end_rank")))
    nth = F.col("rank") - F.col("first_rank")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("sequence") + F.expr("(rank - first_rank) div per_sequence")).alias("sequence_id"),
        (F.col("place") + nth % F.col("per_sequence") * F.col("length")).alias("offset"),
    )
