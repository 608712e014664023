"""Quality classifier: random-indexing word vectors, pooled, under a two-layer network.

Every word has up to three units: its letters in lower case, its shape of capitals and
its marks. A unit stands in one of ``UNITS`` rows by its hash and has a sparse ternary
index vector drawn from that number. A unit's context vector sums the index vectors of the
words around it over all documents, which takes no labels; the sums are whole numbers made
by a Spark aggregation, so they do not depend on how rows are dealt out. A document is the
mean of its units' vectors with a few figures on repetition, and a two-layer network, fitted with
numpy on at most ``sample`` labelled rows and calibrated by a temperature on rows it has
not seen, gives the probability.

Defined results: null and empty texts have no units and are scored all the same; rows
whose doc_id has the remainder 2 are never learnt from; labels that are null or neither 0
nor 1 are ignored, and of several labels of one document the least counts, and of several
texts of one doc_id the least by hash is learnt from; without labels
of both kinds every score is 0.5. Equal rows are scored each; no other column is read.
"""

import itertools
import zlib
from collections import Counter
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import fraction

UNITS, WIDTH, NONZERO, AROUND = 2**15, 64, 8, 2
FIGURES = 5
#: Fixed by the contract.
FOLDS, HELD_OUT, ACCEPT = 4, 2, 0.7
_MOST_KNOWN = 250_000
#: Marks that commonly end a word, none a letter.
_ENDS = ".,;:!?)]}\"'%$#*&"
#: Words whose contexts are summed in one go, and numbers that a step of that holds at once.
_AT_ONCE, _CELLS = 100_000, 1 << 20


@cache
def index_vectors() -> np.ndarray:
    """The ternary index vectors of all units, and of none in the last row."""
    draw = np.random.default_rng(20240)
    vectors = np.zeros((UNITS + 1, WIDTH), dtype=np.int8)
    for row in vectors[:UNITS]:
        row[draw.choice(WIDTH, NONZERO, replace=False)] = draw.choice((-1, 1), NONZERO)
    return vectors


def _shape(letters: str) -> str:
    if letters.islower():
        return "lower"
    if letters.isupper():
        return "upper" if len(letters) > 1 else "title"
    return "title" if letters[1:].islower() else "mixed"


@cache
def _kind(text: str) -> int:
    """The unit of a shape."""
    return zlib.crc32(f" {text}".encode()) % UNITS


def _units_of(word: str) -> tuple[int, int, int]:
    """The unit numbers of a word's letters, shape and marks; UNITS stands for none."""
    letters, marks = word, ""
    if not word.isalpha():
        letters = word.rstrip(_ENDS)
        marks = word[len(letters) :]
        if not letters.isalpha():
            letters = "".join(filter(str.isalpha, word))
            marks = "".join(c for c in word if not c.isalpha())
    return (
        zlib.crc32(letters.lower().encode()) % UNITS if letters else UNITS,
        _kind(_shape(letters)) if letters else UNITS,
        zlib.crc32(f" {marks}".encode()) % UNITS if marks else UNITS,
    )


class Units:
    """Numbers of words, and the three units of each; as many as fit the bounds are kept."""

    def __init__(self, most: int = _MOST_KNOWN, most_chars: int = 64 * _MOST_KNOWN):
        self.most, self.most_chars = most, most_chars
        self.codes: dict[str, int] = {}
        self.units = np.zeros((1024, 3), dtype=np.int32)
        self.chars = 0

    def numbers(self, words: Collection[str]) -> np.ndarray:
        """Per word a row of ``units``, which holds until the next call."""
        new = list(itertools.filterfalse(self.codes.__contains__, set(words)))
        if new and (len(self.codes) + len(new) > self.most or self.chars > self.most_chars):
            self.codes, self.chars, new = {}, 0, list(set(words))
        if new:
            known = len(self.codes)
            if known + len(new) > len(self.units):
                grown = np.zeros((2 * (known + len(new)), 3), dtype=np.int32)
                grown[:known] = self.units[:known]
                self.units = grown
            each = itertools.chain.from_iterable(map(_units_of, new))
            self.units[known : known + len(new)] = np.fromiter(each, np.int32).reshape(-1, 3)
            self.codes.update(zip(new, range(known, known + len(new))))
            self.chars += sum(map(len, new))
        return np.fromiter(map(self.codes.__getitem__, words), dtype=np.int64, count=len(words))

    def of_all(self, words: Collection[str]) -> np.ndarray:
        """A row of three unit numbers for each word."""
        rows = self.numbers(words)
        return self.units[rows]

    def __call__(self, word: str) -> tuple[int, int, int]:
        """The three unit numbers of a word; UNITS stands for none."""
        return _units_of(word)


@cache
def units() -> Units:
    """One for each Python process."""
    return Units()


@cache
def _entries() -> np.ndarray:
    """The places of the units' index vectors' entries, a row for the first of each and so on:
    twice the column and one more if negative; for no unit a column of its own."""
    vectors = index_vectors()
    places = np.full((UNITS + 1, NONZERO), 2 * WIDTH, dtype=np.int64)
    for unit, row in enumerate(vectors[:UNITS]):
        columns = np.flatnonzero(row)
        places[unit] = 2 * columns + (row[columns] < 0)
    return np.ascontiguousarray(places.T)


def _add(sums: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
    """Add vectors to rows, several to one."""
    order = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.diff(rows[order], prepend=-1))
    if len(first):
        sums[rows[order][first]] += np.add.reduceat(vectors[order], first, axis=0)


def _products(
    keys: list[np.ndarray], rows: int, columns: int, left: np.ndarray, right: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The counts of ``row * columns + column``, as a matrix, times the vectors of its
    columns, and its transpose times those of its rows. Whole numbers, exact as doubles.

    The matrix is made some rows at a time; where it is large for what it holds, only the
    places that occur are, some at a time too.
    """
    met = np.sort(np.concatenate(keys))
    forth = np.zeros((rows, right.shape[1]), dtype=np.int64)
    back = np.zeros((columns, left.shape[1]), dtype=np.int64)
    if rows * columns <= 1 << 23:
        step = max(1, _CELLS // columns)
        for first in range(0, rows, step):
            last = min(first + step, rows)
            start, end = np.searchsorted(met, (first * columns, last * columns))
            if start < end:
                places = met[start:end] - first * columns
                counts = np.bincount(places, minlength=(last - first) * columns).astype(float)
                counts = counts.reshape(-1, columns)
                forth[first:last] = (counts @ right).astype(np.int64)
                back += (counts.T @ left[first:last]).astype(np.int64)
        return forth, back
    met, many = np.unique(met, return_counts=True)
    step = max(1, _CELLS // max(left.shape[1], right.shape[1]))
    for first in range(0, len(met), step):
        row, column = np.divmod(met[first : first + step], columns)
        times = many[first : first + step, None]
        _add(forth, row, right[column].astype(np.int64) * times)
        _add(back, column, left[row].astype(np.int64) * times)
    return forth, back


class Contexts:
    """Sums of index vectors around each unit.

    Letters are many units, shapes and marks few kinds of pairs. So what stands around
    letters is counted by entry for neighbours' letters, and by kind for the rest; what
    stands around a kind is, the window being even, the same counts read the other way.
    """

    def __init__(self):
        self.vectors = index_vectors().astype(float)
        self.wide = 2 * WIDTH + 2
        self.letters = np.zeros((UNITS + 1) * self.wide, dtype=np.int64)
        self.sums = np.zeros((UNITS + 1, WIDTH), dtype=np.int64)

    def add(self, texts: list[list[str]]) -> None:
        # AROUND places that hold no word keep texts apart
        gap = [""] * AROUND
        words = list(itertools.chain.from_iterable(part for text in texts for part in (text, gap)))
        if len(words) == len(gap) * len(texts):
            return
        ids = units().of_all(words)
        letters = ids[:, 0].astype(np.int64)
        here, letter = np.unique(letters, return_inverse=True)
        kinds, kind = np.unique(ids[:, 1].astype(np.int64) * (UNITS + 1) + ids[:, 2], return_inverse=True)
        shapes, marks = np.divmod(kinds, UNITS + 1)
        each = self.vectors[shapes] + self.vectors[marks]
        many = len(kinds)
        met, pairs, near = [], [], []
        for away in range(1, AROUND + 1):
            later, earlier = slice(away, None), slice(None, -away)
            near += [(later, earlier), (earlier, later)]
        for own, other in near:
            met.append(letter[own] * many + kind[other])
            pairs.append(kind[own] * many + kind[other])
        base = letters * self.wide
        for entry in _entries():
            place = entry[letters]
            for own, other in near:
                np.add.at(self.letters, base[own] + place[other], 1)
        forth, around = _products(met, len(here), many, self.vectors[here], each)
        self.sums[here] += forth
        around += _products(pairs, many, many, each, each)[0]
        np.add.at(self.sums, shapes, around)
        np.add.at(self.sums, marks, around)

    def total(self) -> np.ndarray:
        counted = self.letters.reshape(UNITS + 1, self.wide)[:, : 2 * WIDTH]
        return self.sums + counted[:, ::2] - counted[:, 1::2]


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of index vectors around each unit, as rows (unit, vector)."""
    found = Contexts()
    for batch in batches:
        texts, many = [], 0
        for text in batch.column("text"):
            texts.append((text.as_py() or "").split())
            many += len(texts[-1])
            if many >= _AT_ONCE:
                found.add(texts)
                texts, many = [], 0
        found.add(texts)
    sums = found.total()
    there = np.flatnonzero(sums[:UNITS].any(axis=1))
    for part in np.array_split(there, len(there) // 1000 + 1):
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int64()), pa.array(list(sums[part]), pa.list_(pa.int64()))],
            names=["unit", "vector"],
        )


def _scaled(unit: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Index vectors of units plus their context sums, each of length 1 at most."""
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    own = index_vectors()[unit] / np.sqrt(NONZERO)
    return (own + sums / np.maximum(length, 1e-9)).astype(np.float32)


def _scaled_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (unit, vector) of units with the sums of their contexts."""
    for batch in batches:
        sums = batch.column("vector").flatten().to_numpy().astype(float).reshape(-1, WIDTH)
        made = _scaled(batch.column("unit").to_numpy(), sums)
        ends = pa.array(np.arange(0, made.size + 1, WIDTH, dtype=np.int32))
        lists = pa.ListArray.from_arrays(ends, pa.array(made.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("unit"), lists], names=["unit", "vector"])


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Unit vectors: own index and context, each of length 1 at most. Bounded by UNITS.

    They are scaled where they are summed and come as Arrow batches, so that the driver
    never holds them as objects, number by number.
    """
    sums = texts.select("text").mapInArrow(contexts, "unit bigint, vector array<bigint>")
    summed = sums.groupBy("unit").agg(
        F.array(*[F.sum(F.col("vector")[i]) for i in range(WIDTH)]).alias("vector")
    )
    made = summed.mapInArrow(_scaled_rows, "unit bigint, vector array<float>").toArrow()
    out = np.empty((UNITS + 1, WIDTH), dtype=np.float32)
    for part in np.array_split(np.arange(UNITS + 1), 64):
        out[part] = _scaled(part, np.zeros((len(part), WIDTH)))
    for batch in made.to_batches():
        vectors = batch.column("vector").flatten().to_numpy()
        out[batch.column("unit").to_numpy()] = vectors.reshape(-1, WIDTH)
    return out


def features(text: "str | None", vectors: np.ndarray) -> np.ndarray:
    """A document's pooled vector and its figures on length and repetition."""
    words = (text or "").split()
    out = np.zeros(WIDTH + FIGURES, dtype=np.float32)
    if not words:
        return out
    counts = Counter(words)
    ids = units().of_all(counts)
    share = np.fromiter(counts.values(), dtype=np.float32, count=len(counts)) / len(words)
    out[:WIDTH] = sum(share @ vectors[column] for column in ids.T)
    same = sum(map(str.__eq__, words, words[1:])) / len(words)
    out[WIDTH:] = (
        1.0,
        same,
        share.max(),
        len(counts) / len(words),
        np.log1p(len(words)) / 10,
    )
    return out


@dataclass
class Network:
    """Two layers and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    bias: np.ndarray
    second: np.ndarray
    shift: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        # row by row, so that a score does not depend on the rows it is computed with
        seen = np.einsum("ri,ih->rh", (x - self.mean) / self.scale, self.first)
        hidden = np.tanh(seen + self.bias)
        return (np.einsum("rh,h->r", hidden, self.second) + self.shift) / self.temperature

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 400) -> Network | None:
    """The network for rows x with labels y, or None without both labels among them."""
    if len(set(y.tolist())) < 2:
        return None
    draw = np.random.default_rng(7)
    order = draw.permutation(len(y))
    seen, rest = order[: max(1, len(y) * 4 // 5)], order[len(y) * 4 // 5 :]
    mean, scale = x[seen].mean(axis=0), x[seen].std(axis=0) + 1e-3
    net = Network(
        mean,
        scale,
        draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)),
        np.zeros(hidden),
        draw.normal(0, 1 / np.sqrt(hidden), hidden),
        0.0,
    )
    z, t = (x[seen] - mean) / scale, y[seen].astype(float)
    moments: dict[str, tuple] = {}
    for step in range(1, rounds + 1):
        h = np.tanh(z @ net.first + net.bias)
        p = 1 / (1 + np.exp(-np.clip(h @ net.second + net.shift, -60, 60)))
        error = (p - t) / len(t)
        back = np.outer(error, net.second) * (1 - h * h)
        slopes = {
            "first": z.T @ back + 1e-3 * net.first,
            "bias": back.sum(axis=0),
            "second": h.T @ error + 1e-3 * net.second,
            "shift": error.sum(),
        }
        for name, slope in slopes.items():  # Adam
            m, v = moments.get(name, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
            moments[name] = (m, v)
            move = 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            setattr(net, name, getattr(net, name) - move)
    if len(rest):
        logits, truth = net.logit(x[rest]), y[rest]
        signed = np.where(truth == 1, logits, -logits)
        tried = np.geomspace(0.25, 8, 101)
        net.temperature = float(min(tried, key=lambda k: np.logaddexp(0, -signed / k).mean()))
    return net


def held_out() -> Column:
    """Whether a document's label must not be learnt from."""
    number = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    return F.coalesce(number == HELD_OUT, F.lit(False))


def network(
    docs: DataFrame, labels: DataFrame, shared: Broadcast, sample: int = 4000
) -> Network | None:
    """The network over the shared word vectors, fitted on at most ``sample`` labelled rows."""
    usable = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = (
        usable.groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(fraction(F.col("doc_id").cast("string")), "doc_id")
        .limit(sample)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # of several texts of a doc_id the least by hash, however the rows are dealt out
    told = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    rows = rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), told.alias("told"))
    rows = rows.select("doc_id", "quality", "told.text")

    def pooled(batches):
        for batch in batches:
            made = [features(t.as_py(), shared.value) for t in batch.column("text")]
            made = pa.array([m.astype(float).tolist() for m in made], pa.list_(pa.float64()))
            kept = batch.select(["doc_id", "quality"]).columns
            yield pa.RecordBatch.from_arrays([*kept, made], names=["doc_id", "quality", "features"])

    typed = rows.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int"), "text")
    made = typed.mapInArrow(pooled, "doc_id bigint, quality int, features array<double>").toArrow()
    order = np.argsort(made.column("doc_id").to_numpy(), kind="stable")
    x = made.column("features").combine_chunks().flatten().to_numpy()
    x = x.reshape(made.num_rows, WIDTH + FIGURES)[order]
    return fit(x, made.column("quality").to_numpy()[order])


def learn(docs: DataFrame, labels: DataFrame, sample: int = 4000):
    """The word vectors of all documents, and the network, fitted on at most ``sample``
    labelled rows."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    return vectors, network(docs, labels, shared, sample)


def scorer(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> Callable[[str], Column]:
    """What gives the probability of label 1 for a text column."""
    # UNITS x WIDTH numbers, whatever the corpus holds; sent once, for learning and scoring
    shared = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))
    net = network(docs, labels, shared, sample)

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        if net is None:
            return pd.Series(np.full(len(texts), 0.5))
        made = np.zeros((len(texts), WIDTH + FIGURES))
        for i, text in enumerate(texts):
            made[i] = features(text, shared.value)
        return pd.Series(net.probability(made))

    return probability


def judged(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    scored = docs.select("doc_id", scorer(docs, labels, sample)("text").alias("score"))
    predicted = (F.col("score") >= ACCEPT).cast("int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> DataFrame:
    """The documents whose score is good enough, with their columns."""
    return docs.filter(scorer(docs, labels, sample)("text") >= ACCEPT)
