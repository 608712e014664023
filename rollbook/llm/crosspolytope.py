"""Approximate nearest neighbours by cross-polytope hashing.

A table hashes unit vectors by several pseudo-rotations, three rounds of random signs and a
fast Hadamard transform each; the nearest signed axes of all of them together are a vector's
bucket. The number of axes grows with the index, so that a bucket holds some four vectors
at every size; the last rotation may use its first coordinates only. A query looks into
the joint buckets whose axes are nearest to it in sum, as many as four times the root of
their number: what is compared for a query grows as the root of the index.

Buckets next to each other make a cell. Rows of a cell are dealt into blocks, and so are
the queries that look into it, so a cell may hold any share of the rows. A query is compared
with the rows of the buckets it named; only its best few leave a block. All candidates that
a query finds are ranked by their exact cosine.

Defined results: vectors that are null, empty or zero, or hold null or non-finite numbers,
take no part, nor do rows without vec_id; vectors are compared with those of their own
length only; rows with one vec_id are one candidate, the nearest; of vectors equally near
the smaller vec_id comes first. Finite entries of any size are scaled by a power of two
before they are squared, which changes no cosine. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.sources.staging import stage

TABLES = 6
FILL, REACH = 4, 4  # vectors a bucket holds on average; probes for the root of all buckets
MOST_PARTS = 4
CELL = 1024  # buckets
BLOCK_ROWS, BLOCK_QUERIES = 4096, 4096


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Hadamard transform of each row; the width is a power of two."""
    width, half = x.shape[1], 1
    while half < width:
        pairs = x.reshape(-1, width // (2 * half), 2, half)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2)
        x, half = x.reshape(-1, width), half * 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, table: int, part: int = 0) -> np.ndarray:
    """The rows turned by a pseudo-rotation, padded to a power of two."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    draw = np.random.default_rng([97, table, part, width])
    for _ in range(3):
        x = _hadamard(x * draw.choice((-1.0, 1.0), width))
    return x


def parts(known: int, length: int) -> tuple[int, ...]:
    """Signed axes in each rotation of a table over ``known`` vectors, powers of two."""
    whole = max(0, length - 1).bit_length() + 1
    bits = max(whole, math.ceil(math.log2(max(1, known / FILL))))
    bits = min(bits, MOST_PARTS * whole)
    return tuple(1 << min(whole, bits - at) for at in range(0, bits, whole))


@functools.lru_cache
def _ranks(axes: tuple[int, ...], probes: int) -> np.ndarray:
    """Ranks of axes, one of each part, that can be among the nearest: a combination has at
    least as many before it as the product of its ranks."""
    chosen = np.arange(min(axes[0], probes))[:, None]
    for count in axes[1:]:
        room = probes // np.prod(chosen + 1, axis=1)
        more = [np.arange(min(count, r)) for r in room]
        chosen = np.column_stack([np.repeat(chosen, [len(m) for m in more], axis=0), np.concatenate(more)])
    return chosen


def _signed(x: np.ndarray, table: int, part: int, count: int) -> np.ndarray:
    turned = rotated(x, table, part)[:, : count // 2]
    return np.concatenate([turned, -turned], axis=1)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that the largest entry is near one."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def buckets(vectors: np.ndarray, axes: tuple[int, ...], tables: int, probes: int) -> np.ndarray:
    """Per vector and table the ``probes`` nearest joint buckets, nearest first."""
    unit = scaled(vectors)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    found = []
    for table in range(tables):
        seen = [_signed(unit, table, p, count) for p, count in enumerate(axes)]
        if probes == 1:
            joint = functools.reduce(lambda a, s: a * s.shape[1] + s.argmax(axis=1), seen, 0)
            found.append(joint[:, None])
            continue
        order = [np.argsort(-s, axis=1, kind="stable") for s in seen]
        ranks = _ranks(axes, probes)
        near = sum(
            np.take_along_axis(s, o, axis=1)[:, ranks[:, p]]
            for p, (s, o) in enumerate(zip(seen, order, strict=True))
        )
        joint = np.zeros((len(unit), len(ranks)), dtype=np.int64)
        for p, (o, count) in enumerate(zip(order, axes, strict=True)):
            joint = joint * count + o[:, ranks[:, p]]
        best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
        found.append(np.take_along_axis(joint, best, axis=1))
    return np.stack(found, axis=1)


def probes_for(axes: tuple[int, ...], known: int) -> int:
    """So many that a query reaches REACH times the root of the buckets, each filled."""
    count = math.prod(axes)
    thin = max(1.0, count * FILL / max(1, known))
    return min(count, math.ceil(REACH * math.sqrt(count) * thin))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _hashed(known: int, tables: int, ask: bool):
    """Per vector the cells it is filed in, or looks into, with the buckets there."""
    cells = pa.list_(pa.struct([("cell", pa.int64()), ("named", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                lengths = np.array([len(v) for v in batch.column("vector")])
                for length in np.unique(lengths):
                    rows = batch.take(pa.array(np.flatnonzero(lengths == length)))
                    axes = parts(known, int(length))
                    probes = probes_for(axes, known) if ask else 1
                    made = buckets(_matrix(rows.column("vector")), axes, tables, probes)
                    out = [_by_cell(row, int(length)) for row in made]
                    yield pa.RecordBatch.from_arrays(
                        [*rows.select(["vec_id", "vector"]).columns, pa.array(out, cells)],
                        names=["vec_id", "vector", "cells"],
                    )

    return run


def _by_cell(named: np.ndarray, length: int) -> list[dict]:
    """Buckets by table, as numbers within cells unlike for unlike tables and lengths."""
    made = []
    for table, joint in enumerate(named):
        joint = np.sort(joint)
        cells, first = np.unique(joint // CELL, return_index=True)
        for cell, some in zip(cells, np.split(joint % CELL, first[1:]), strict=True):
            made.append({"cell": (length << 48) + (table << 40) + int(cell), "named": some})
    return made


def _best(nearest: int):
    """The nearest vec_ids of a block for each query of a block, each with its best row."""

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids = table.column("vec_id").to_numpy()
        vectors = scaled(_matrix(table.column("vector")))
        # a row's own sum, and not a matrix product's, is the same in every block
        length = np.sqrt((vectors * vectors).sum(axis=1))
        named = table.column("named").combine_chunks()
        rows = np.flatnonzero(~asks)
        # rows of one vec_id side by side, so that each counts once, by its best
        rows = rows[np.argsort(ids[rows], kind="stable")]
        filed = named.take(pa.array(rows)).flatten().to_numpy()
        row_ids, row_vectors, row_length = ids[rows], vectors[rows], length[rows]
        unit = row_vectors / row_length[:, None]
        out: list[tuple[int, int, float]] = []
        for at in np.flatnonzero(asks):
            looked = np.zeros(CELL, dtype=bool)
            looked[named[at].values.to_numpy()] = True
            seen = np.flatnonzero(looked[filed] & (row_ids != ids[at]))
            if not len(seen):
                continue
            near = unit[seen] @ (vectors[at] / length[at])
            _, first = np.unique(row_ids[seen], return_index=True)
            least = np.sort(np.maximum.reduceat(near, first))[-nearest:][0] - 1e-9
            chosen = seen[near >= least]
            exact = (row_vectors[chosen] * vectors[at]).sum(axis=1) / (row_length[chosen] * length[at])
            order = np.lexsort((row_ids[chosen], -exact))
            once = np.sort(np.unique(row_ids[chosen][order], return_index=True)[1])
            out += [(ids[at], row_ids[chosen][k], exact[k]) for k in order[once[:nearest]]]
        columns = zip(*out, strict=True) if out else ((), (), ())
        kinds = (pa.int64(), pa.int64(), pa.float64())
        arrays = [pa.array([*c], k) for c, k in zip(columns, kinds, strict=True)]
        return pa.table(arrays, names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that take part; entries keep their type."""
    finite = F.forall(
        "embedding",
        lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)),
    )
    nonzero = F.exists("embedding", lambda x: x != 0)
    rows = vectors.filter(F.col("vec_id").isNotNull() & finite & nonzero)
    return rows.select(F.col("vec_id").cast("bigint"), F.col("embedding").alias("vector"))


def search(
    vectors: DataFrame, every: int = 50, nearest: int = 5, tables: int = TABLES
) -> DataFrame:
    """The nearest other rows of the rows whose vec_id is divisible by ``every``.

    Columns: query_id, rank (from 1), vec_id, score.
    """
    rows = usable(vectors)
    known = rows.count()
    kind = rows.schema["vector"].dataType.simpleString()
    schema = f"vec_id bigint, vector {kind}, cells array<struct<cell: bigint, named: array<bigint>>>"
    filed = stage(rows.mapInArrow(_hashed(known, tables, False), schema), "filed")
    asking = rows.filter(F.col("vec_id") % every == 0)
    asking = stage(asking.mapInArrow(_hashed(known, tables, True), schema), "asking")

    def placed(frame: DataFrame) -> DataFrame:
        return frame.select("vec_id", "vector", F.explode("cells").alias("at")).select("vec_id", "vector", "at.*")

    def blocks(frame: DataFrame, most: int, name: str) -> DataFrame:
        counts = placed(frame).groupBy("cell").agg(F.count("*").alias("n"))
        return counts.select("cell", F.ceil(F.col("n") / most).cast("int").alias(name))

    # a row for each cell that is looked into
    shape = blocks(filed, BLOCK_ROWS, "row_blocks").join(
        blocks(asking, BLOCK_QUERIES, "ask_blocks"), "cell"
    )
    shape = stage(shape, "blocks", plain=True)
    spread = F.xxhash64("vec_id", "cell")
    row_side = placed(filed).join(shape, "cell").select(
        "cell",
        F.pmod(spread, F.col("row_blocks")).cast("int").alias("row_block"),
        F.explode(F.expr("sequence(0, ask_blocks - 1)")).alias("ask_block"),
        F.lit(False).alias("asks"),
        "vec_id",
        "vector",
        "named",
    )
    ask_side = placed(asking).join(shape, "cell").select(
        "cell",
        F.explode(F.expr("sequence(0, row_blocks - 1)")).alias("row_block"),
        F.pmod(spread, F.col("ask_blocks")).cast("int").alias("ask_block"),
        F.lit(True).alias("asks"),
        "vec_id",
        "vector",
        "named",
    )
    met = row_side.unionByName(ask_side).groupBy("cell", "row_block", "ask_block")
    found = met.applyInArrow(_best(nearest), "query_id bigint, vec_id bigint, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")
