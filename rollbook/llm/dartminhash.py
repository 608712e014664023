"""Near duplicates by DartMinHash: banded signatures of weighted shingle sets.

A document is the multiset of its five-word shingles; a shingle found c times is an
element of weight c. Darts are thrown at the plane of elements and ranks: each unit of an
element's weight is hit by a Poisson stream of darts along the rank axis, drawn from the
element alone, and each dart carries a coordinate. Only ranks up to about
(k ln k + 2k) / weight are looked at, so a document costs its own length and some k ln k
darts, not k passes. A coordinate keeps its earliest dart; two documents agree in it with
the probability of their weighted Jaccard similarity. Documents with a coordinate left
empty go on to higher ranks.

Bands of the signature are buckets. Equal multisets count as one node beforehand. Every
node of a bucket is compared, exactly, with the most central node there (whose buckets
hold the most), which links groups of near copies. Where a bucket still holds nodes of
several components, its nodes meet block by block: those of other components than most
against all, by the units of their multisets, and only links leave a block. Nodes that can
have no link to another component are left out before: in an order of units from rare to
common, with those that stand in one component first, a pair of 0.8 or more shares one of
the first fifth. Classes are the connected components of the links found.

Defined results: texts of one to four words are one shingle; texts without words (null
too) have no shingles and are equal to each other; a class is named by its least doc_id,
and by null if it has none; equal rows are in one class. No other column is read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.components import components
from rollbook.llm.shared import ROW, numbered
from rollbook.sources.staging import stage

WORDS, SIMILAR = 5, 0.8
#: A pair at 0.8 shares one of 26 bands of 5 coordinates with probability 0.99997.
BANDS, PER_BAND = 26, 5
COORDINATES = BANDS * PER_BAND
#: Nodes of a bucket that are compared at a time.
BLOCK_ROWS, BLOCK_ASKS = 512, 128
_BLANKS = {ord(c): " " for c in "\t\n\x0b\x0c\r"}
_MOST_KNOWN = 500_000
_known: dict[str, int] = {}


def _hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes; those of frequent words are kept in the process."""
    new = list(itertools.filterfalse(_known.__contains__, set(words)))
    if len(_known) + len(new) > _MOST_KNOWN:
        _known.clear()
        new = list(set(words))
    _known.update(zip(new, map(xxhash.xxh64_intdigest, new)))
    return np.fromiter(map(_known.__getitem__, words), dtype=np.uint64, count=len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit numbers from any others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of a text, in order, and how often each occurs."""
    words = [w for w in (text or "").translate(_BLANKS).split(" ") if w]
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    each, width = _hashes(words), min(WORDS, len(words))
    made = np.full(len(each) - width + 1, width, dtype=np.uint64)
    for i in range(width):
        made = _mixed(made * np.uint64(0x9E3779B97F4A7C15) + each[i : len(each) - width + 1 + i])
    return np.unique(made, return_counts=True)


def similarity(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, a, b = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
    both = np.minimum(one[1][a], other[1][b]).sum()
    return float(both / max(1, one[1].sum() + other[1].sum() - both))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = COORDINATES) -> np.ndarray:
    """A row of k darts for each multiset, which must not be empty."""
    out = np.zeros((len(sets), k), dtype=np.uint64)
    todo, reach = np.arange(len(sets)), k * np.log(k) + 2 * k
    while len(todo):
        out[todo], empty = _thrown([sets[i] for i in todo], k, reach)
        todo, reach = todo[empty], reach * 2
    return out


def _thrown(sets: list, k: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Each coordinate's earliest dart below the rank reach / weight; which rows lack one."""
    counts = [c for _, c in sets]
    weight = np.array([c.sum() for c in counts])
    owner = np.repeat(np.arange(len(sets)), weight)
    unit = np.concatenate([np.repeat(s, c) for s, c in sets])
    # number the units of an element's weight: 0, 1, ...
    each = np.concatenate(counts)
    first = np.repeat(np.cumsum(each) - each, each)
    unit = _mixed(unit + np.arange(len(unit), dtype=np.uint64) - first.astype(np.uint64))
    limit = (reach / weight)[owner]
    rank, darts, n = np.zeros(len(unit)), [], 0
    while len(unit):
        n += 1
        draw = _mixed(unit + np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))
        rank = rank - np.log(((draw >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53)
        hit = rank <= limit
        owner, unit, limit, rank, draw = (x[hit] for x in (owner, unit, limit, rank, draw))
        dart = _mixed(draw + np.uint64(0xD1B54A32D192ED03))
        darts.append((owner * k + (dart % np.uint64(k)).astype(np.int64), rank, dart))
    cell, rank, dart = (np.concatenate(x) for x in zip(*darts, strict=True))
    first = np.full(len(sets) * k, np.inf)
    np.minimum.at(first, cell, rank)
    earliest = np.flatnonzero(rank == first[cell])[::-1]  # of equal ranks the first one stays
    out, there = np.zeros(len(sets) * k, np.uint64), np.isfinite(first)
    out[cell[earliest]] = dart[earliest]
    return out.reshape(-1, k), ~there.reshape(-1, k).all(axis=1)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: ROW, doc_id, a digest of its multiset in two halves, and its buckets."""
    names = [*ROW, "doc_id", "digest", "digest_too", "buckets"]
    band = np.arange(BANDS, dtype=np.uint64)
    for whole in batches:
        for at in range(0, len(whole), 500):
            batch = whole.slice(at, 500)
            sets = [shingles(t.as_py()) for t in batch.column("text")]
            digests = [
                hashlib.blake2b(s.tobytes() + c.tobytes(), digest_size=16).digest() for s, c in sets
            ]
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            full = [i for i, (s, _) in enumerate(sets) if len(s)]
            buckets: list = [[] for _ in sets]
            if full:
                rows = signatures([sets[i] for i in full]).reshape(len(full), BANDS, PER_BAND)
                mixed = np.tile(band, (len(full), 1))
                for i in range(PER_BAND):
                    mixed = _mixed(mixed * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
                for i, row in zip(full, mixed.view(np.int64), strict=True):
                    buckets[i] = row
            columns = [
                *batch.select([*ROW, "doc_id"]).columns,
                pa.array(halves[:, 0]),
                pa.array(halves[:, 1]),
                pa.array(buckets, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _similarities(one: pd.Series, other: pd.Series) -> pd.Series:
    last: dict[str, tuple] = {}

    def of(text: str) -> tuple:
        if text not in last:
            if len(last) > 64:
                last.clear()
            last[text] = shingles(text)
        return last[text]

    return pd.Series([similarity(of(a), of(b)) for a, b in zip(one, other, strict=True)], dtype=float)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The units of each text's multiset: an element of weight c is c units."""
    for whole in batches:
        for at in range(0, len(whole), 100):
            batch = whole.slice(at, 100)
            made = []
            for text in batch.column("text"):
                elements, counts = shingles(text.as_py())
                first = np.repeat(np.cumsum(counts) - counts, counts)
                nth = (np.arange(len(first)) - first).astype(np.uint64)
                made.append(_mixed(np.repeat(elements, counts) + nth).view(np.int64))
            arrays = [*batch.select(["node", "component"]).columns, pa.array(made, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "component", "units"])


def _links(table: pa.Table) -> pa.Table:
    """Of the nodes that ask and those that answer: the pairs of SIMILAR or more."""
    asks = table.column("asks").to_numpy()
    node, component = table.column("node").to_numpy(), table.column("component").to_numpy()
    units = table.column("units").combine_chunks()
    sizes = units.value_lengths().to_numpy()
    each, code = np.unique(units.flatten().to_numpy(), return_inverse=True)
    ends = np.cumsum(sizes)
    rows = np.flatnonzero(~asks)
    filed = np.concatenate([code[:0], *[code[ends[r] - sizes[r] : ends[r]] for r in rows]])
    first = np.cumsum(sizes[rows]) - sizes[rows]
    found: list[tuple[int, int]] = []
    for ask in np.flatnonzero(asks) if len(rows) else ():
        own = np.zeros(len(each), dtype=np.int64)
        own[code[ends[ask] - sizes[ask] : ends[ask]]] = 1
        both = np.add.reduceat(own[filed], first)
        enough = both >= SIMILAR * (sizes[rows] + sizes[ask] - both) - 1e-9
        enough &= component[rows] != component[ask]
        found += [(node[r], node[ask]) for r in rows[enough]]
    columns = zip(*found, strict=True) if found else ((), ())
    return pa.table([pa.array([*c], pa.int64()) for c in columns], names=["node", "centre"])


def _apart(component: DataFrame, met: DataFrame, texts: DataFrame) -> DataFrame:
    """All links between nodes of unlike components that share a bucket."""
    placed = met.select("node", "bucket").join(component, "node")
    sides = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    mixed = sides.filter("low < high").select("bucket")
    crowd = stage(placed.join(mixed, "bucket"), "crowd", plain=True)
    units = texts.join(crowd.select("node", "component").distinct(), "node")
    units = units.select("node", "component", "text").mapInArrow(
        _units, "node bigint, component bigint, units array<bigint>"
    )
    units = stage(units, "units", sized=True)

    single = units.select("node", "component", F.size("units").alias("size"), F.explode("units").alias("unit"))
    spread = single.groupBy("unit").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    joint = single.join(spread.filter("low < high").select("unit"), "unit")
    counts = joint.groupBy("node", "size").agg(F.count("*").alias("joint"))
    able = counts.filter(F.col("joint") >= F.ceil(SIMILAR * F.col("size") - 1e-9))
    able = stage(able.select("node"), "able", plain=True)

    there = crowd.join(able, "node")
    sizes = there.groupBy("bucket", "component").agg(F.count("*").alias("many"))
    shape = sizes.groupBy("bucket").agg(
        F.max(F.struct("many", "component")).alias("most"), F.sum("many").alias("rows")
    )
    shape = shape.select(
        "bucket",
        F.col("most.component").alias("most"),
        F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("row_blocks"),
        F.ceil((F.col("rows") - F.col("most.many")) / BLOCK_ASKS).cast("int").alias("ask_blocks"),
    )
    shape = stage(shape.filter("ask_blocks > 0"), "shape", plain=True)
    dealt = there.join(shape, "bucket").withColumn("spread", F.xxhash64("node", "bucket"))

    def block(count: str) -> Column:
        return F.pmod(F.col("spread"), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    answers = dealt.select(
        "bucket",
        "node",
        F.lit(False).alias("asks"),
        block("row_blocks").alias("row_block"),
        every("ask_blocks").alias("ask_block"),
    )
    questions = dealt.filter("component <> most").select(
        "bucket",
        "node",
        F.lit(True).alias("asks"),
        every("row_blocks").alias("row_block"),
        block("ask_blocks").alias("ask_block"),
    )
    meeting = answers.unionByName(questions).join(units, "node")
    meeting = meeting.groupBy("bucket", "row_block", "ask_block")
    links = meeting.applyInArrow(_links, "node bigint, centre bigint")
    return stage(links.distinct(), "found")


def grouped(docs: DataFrame, stored: bool = False) -> DataFrame:
    """Per row: ROW, doc_id and its component, the number of a node."""
    rows = numbered(docs, "doc_id", "text", stored=stored)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("bigint"))
    signed = stage(
        rows.select(*ROW, "doc_id", "text").mapInArrow(
            _signed,
            "row_file bigint, row_index bigint, doc_id bigint, digest bigint, digest_too bigint,"
            " buckets array<bigint>",
        ),
        "signed",
    )
    nodes = stage(
        signed.dropDuplicates(["digest", "digest_too"]).select(
            F.monotonically_increasing_id().alias("node"), *ROW, "digest", "digest_too", "buckets"
        ),
        "nodes",
    )
    placed = nodes.select("node", F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("many")).filter("many > 1")
    met = stage(placed.join(shared, "bucket"), "met")
    central = stage(met.groupBy("node").agg(F.sum("many").alias("weight")), "central", sized=True)
    needed = nodes.join(central, "node").select("node", *ROW)
    texts = stage(rows.join(needed, ROW).select("node", "text"), "texts", sized=True)
    similar = F.pandas_udf(_similarities, "double")
    theirs = texts.select(F.col("node").alias("centre"), F.col("text").alias("centre_text"))

    def linked(pairs: DataFrame) -> DataFrame:
        compared = pairs.join(theirs, "centre").join(texts, "node")
        found = compared.filter(similar("centre_text", "text") >= SIMILAR)
        return stage(found.select("node", "centre"), "links")

    best = met.join(central, "node").groupBy("bucket")
    best = best.agg(F.max(F.struct("weight", "node")).alias("best"))
    best = best.select("bucket", F.col("best.node").alias("centre"))
    tried = stage(met.select("node", "bucket").join(best, "bucket").filter("node <> centre"), "tried")
    links = linked(tried.select("node", "centre").distinct())
    first = stage(components(central.select("node"), links), "first")
    links = links.union(_apart(first, met, texts))
    component = components(nodes.select("node"), links)
    by_digest = nodes.join(component, "node").select("digest", "digest_too", "component")
    return signed.join(by_digest, ["digest", "digest_too"]).select(*ROW, "doc_id", "component")


def classes(docs: DataFrame, stored: bool = False) -> DataFrame:
    """Per document: doc_id and class_id, the least doc_id of its class."""
    rows = stage(grouped(docs, stored), "grouped")
    # staged, so that a large class can be split where it is joined
    least = rows.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    least = stage(least, "least", sized=True)
    return rows.join(least, "component").select("doc_id", "class_id")


def one_of_each(docs: DataFrame, stored: bool = False) -> DataFrame:
    """The documents with the least doc_id of each class, one of each, with their columns."""
    if not stored:
        docs = stage(docs, "documents")
    rows = grouped(docs, stored=True)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", *ROW)
    kept = rows.groupBy("component").agg(F.min(order).alias("kept"))
    kept = kept.select(*[F.col(f"kept.{c}").alias(f"_{c}") for c in ROW])
    place = docs.metadataColumn("_metadata")
    same = (F.xxhash64(place["file_path"]) == F.col("_row_file")) & (
        place["row_index"] == F.col("_row_index")
    )
    return docs.join(kept, same, "left_semi")
