"""Operators on documents: edge cases, and results against plain brute force."""

from __future__ import annotations

import collections
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from conftest import SMALL
from edge_cases import document_rows, documents, prose, stored
from pyspark.sql import functions as F

import corpus_pipeline
from rollbook.llm import dartminhash, linededup, outliers, packing, quality, schedule
from rollbook.llm.queries import TOKENIZER

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    return stored(spark, documents(spark), tmp_path_factory.mktemp("edges") / "documents")


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return stored(spark, documents(spark, []), tmp_path_factory.mktemp("none") / "documents")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


MIDDLE = SMALL.replace("0.001", "0.01")


def texts(df) -> list:
    return sorted(map(str, (r.asDict() for r in df.collect())))


# ---------------------------------------------------------------- quality rules


def brute_statistics(text: str | None) -> tuple:
    words = WORD.findall(text or "")
    places = collections.defaultdict(list)
    for at in range(len(words) - 4):
        places[tuple(words[at : at + 5])].append(at)
    covered = {k + i for found in places.values() if len(found) > 1 for k in found for i in range(5)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum((text or "").count(s) for s in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_statistics_and_base_rules(spark, edges, small):
    for docs in (edges, small):
        got = outliers.judged(docs).drop("distance").collect()
        want = collections.Counter(
            (r.doc_id, *brute_statistics(r.text)) for r in docs.select("doc_id", "text").collect()
        )
        assert collections.Counter(tuple(r)[:6] for r in got) == want
        for r in got:
            failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
            assert r.base_failed == failed and not (failed and r.kept)


def test_overlapping_repeats_are_counted_once(spark):
    rows = ["a b c d e a b c d e", "a a a a a a a", "a b c d e f", "x a b c d e y a b c d e a b c d e"]
    frame = spark.createDataFrame([(r,) for r in rows], "text STRING")
    got = frame.select(outliers.repeated(F.split("text", " ")).alias("n")).collect()
    assert [r.n for r in got] == [brute_statistics(r)[4] for r in rows]


def test_outliers_of_a_group_are_rejected_and_its_others_kept(spark):
    rows = [(n, prose(n, 120 + n), "en", "a") for n in range(60)]
    rows += [(100 + n, re.sub(r"(\w) ", r"\1### ", prose(n, 90)), "en", "a") for n in range(6)]
    rows += [(200, re.sub(r"(\w) ", r"\1### ", prose(3, 90)), "en", "b")]  # too few to judge by
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING")
    kept = {r.doc_id for r in outliers.judged(frame).filter("kept").collect()}
    assert kept == {*range(60), 200}


@pytest.mark.parametrize("share", [0.3, 0.4, 0.45])
def test_junk_that_is_much_of_a_group(spark, share):
    """Junk of one kind, in a group that also holds many copies of one junk text."""
    good = 150
    junk = int(good * share / (1 - share))
    rows = [(n, prose(n, 120 + n), "en", "a") for n in range(good)]
    rows += [(1000 + n, re.sub(r"(\w) ", r"\1### ", prose(n, 90)), "en", "a") for n in range(junk)]
    rows += [(2000 + n, re.sub(r"(\w) ", r"\1### ", prose(7, 90)), "en", "a") for n in range(2 * good)]
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING")
    kept = {r.doc_id for r in outliers.judged(frame).filter("kept").collect()}
    assert kept == set(range(good))


def test_estimates_follow_the_plain_formulas(spark):
    """Every start concentrated by numpy, and the least determinant, in two groups."""
    draw = np.random.default_rng(3)
    columns = ", ".join(f"x{i} DOUBLE" for i in range(4))
    floors = np.array([f for _, f in outliers.VECTOR])
    data, groups = [], {}
    for group, junk in ((("en", "a"), 30), ((None, None), 0)):
        x = np.round(draw.normal(0, 300, (80, 4)) + [1500, 0, 0, 0])
        x[:junk] = np.round(x[:junk] / 9 + [0, 5000, 900, 0])
        groups[group] = x
        data += [(*group, *map(float, row)) for row in x]
    rows = spark.createDataFrame(data, f"lang STRING, source STRING, {columns}")

    def nearest(x, d):
        bins = np.floor(1000 * np.log1p(d))
        return x[bins <= np.sort(bins)[(len(x) + 4 + 1) // 2 - 1]]

    def estimate(near):
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) + np.diag(floors**2)
        return np.linalg.slogdet(cov)[1], mean, cov

    def distance(x, mean, cov):
        return np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)

    first = outliers._first_distances(rows).collect()
    got = outliers._distance(rows, outliers._concentrated(rows)).collect()
    for group, x in groups.items():
        spread = np.maximum(1.4826 * np.median(np.abs(x - np.median(x, axis=0)), axis=0), floors)
        ways = []
        for start in range(outliers.STARTS):
            begun = [r for r in first if (r.lang, r.source, r.start) == (*group, start)]
            at = np.array([[r.x0, r.x1, r.x2, r.x3] for r in begun])
            d = np.array([r.d for r in begun])
            if start == 0:
                np.testing.assert_allclose(d, (((at - np.median(x, axis=0)) / spread) ** 2).sum(axis=1))
            else:
                centre = at[np.argmin(d)]
                np.testing.assert_allclose(d, (((at - centre) / spread) ** 2).sum(axis=1), atol=1e-9)
            best = estimate(nearest(at, d))
            while True:
                again = estimate(nearest(at, distance(at, *best[1:])))
                if again[0] + outliers.GAIN >= best[0]:
                    break
                best = again
            ways.append(best)
        want = distance(x, *min(ways, key=lambda w: w[0])[1:])
        mine = [r.d for r in got if (r.lang, r.source) == group]
        np.testing.assert_allclose(np.sort(mine), np.sort(want), rtol=1e-8)


def test_outliers_without_rows(nothing):
    assert outliers.judged(nothing).count() == 0


# ---------------------------------------------------------------- quality classifier


def test_held_out_accuracy(spark, small):
    root = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.judged(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 50
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)
    for r in got[:50]:
        assert zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and 0 <= r.score <= 1


def test_held_out_labels_do_not_matter(spark, small):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    turned = labels.withColumn(
        "quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    assert texts(quality.judged(small, labels)) == texts(quality.judged(small, turned))


def test_contexts_cover_documents_without_labels(spark):
    rows = [(n, f"plain words {n} and more words about it") for n in range(12)]
    rows += [(100, "Zyx qua, zyx"), (101, None), (102, "qua")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(n, n % 2) for n in range(12)], "doc_id BIGINT, quality INT")
    index, of = quality.index_vectors().astype(int), quality.units()
    sums = np.zeros(index.shape)
    for _, text in rows:
        words = [list(of(w)) for w in (text or "").split()]
        for i, word in enumerate(words):
            for near in words[max(0, i - quality.AROUND) : i] + words[i + 1 : i + 1 + quality.AROUND]:
                for unit in word:
                    sums[unit] += index[near].sum(axis=0)
    sums[quality.UNITS] = 0
    size = np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    vectors, _ = quality.learn(docs, labels)
    assert np.allclose(vectors, index / np.sqrt(quality.NONZERO) + sums / size, atol=1e-5)
    assert sums[of("zyx")[0]].any()


def test_classifier_edges(spark, edges, nothing):
    labels = spark.createDataFrame(
        [(1, 1), (2, 1), (2, 0), (7, 0), (9, None), (None, 1), (11, 5), (8, 1)],
        "doc_id BIGINT, quality INT",
    )
    got = quality.judged(edges, labels).collect()
    assert len(got) == len(document_rows()) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out is not None for r in got)
    assert {r.score for r in quality.judged(edges, labels.limit(0)).collect()} == {0.5}
    assert quality.judged(nothing, labels).count() == 0
    assert quality.accepted(edges, labels).columns == edges.columns


def test_word_vectors_take_little_of_the_driver(spark):
    # nearly all units occur, so nearly all vectors are made from sums
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.concat(F.lit("w"), F.col("id") * 1000 + i)), " ")
    docs = spark.range(60).select(F.col("id").alias("doc_id"), words.alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    quality.index_vectors()
    tracemalloc.start()
    try:
        quality.scorer(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * (quality.UNITS + 1) * quality.WIDTH * 4


def test_word_vectors_are_scaled_sums(spark):
    texts = ["one Two three, four; one", "zyx two!! (three) 4 one", "", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text STRING")
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    sums = np.zeros((quality.UNITS + 1, quality.WIDTH))
    for part in quality.contexts(iter([batch])):
        sums[part.column("unit").to_numpy()] = part.column("vector").to_pylist()
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    own = quality.index_vectors() / np.sqrt(quality.NONZERO)
    want = (own + sums / np.maximum(length, 1e-9)).astype(np.float32)
    assert sums.any() and np.array_equal(quality.word_vectors(docs), want)
    none = quality.word_vectors(docs.limit(0))
    assert none.dtype == np.float32 and np.array_equal(none, own.astype(np.float32))


# ---------------------------------------------------------------- near duplicates


def test_signatures_estimate_weighted_similarity():
    one = dartminhash.shingles("a b c d e " * 40 + "q r s t u")
    other = dartminhash.shingles("a b c d e " * 30 + "x y z")
    rows = dartminhash.signatures([one, other], 4096)
    assert abs((rows[0] == rows[1]).mean() - dartminhash.similarity(one, other)) < 0.03


def brute_classes(rows: list[tuple]) -> dict[int, int]:
    sets = {i: dartminhash.shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            empty = not len(sets[a][0]) and not len(sets[b][0])
            if empty or dartminhash.similarity(sets[a], sets[b]) >= 0.8:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_classes_are_those_of_all_pairs(spark, small):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    draw = random.Random(5)
    base = prose(20, 160).split(" ")
    for n in range(60):  # a group of near copies, some of them far from each other
        words = list(base)
        for _ in range(draw.randint(0, 4)):
            words[draw.randrange(len(words))] = f"edit{n}"
        rows.append((1_000_000 + n, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.class_id for r in dartminhash.classes(frame).collect()}
    assert got == brute_classes(rows)


def test_a_crowd_on_one_template(spark):
    """3,000 texts of 0.6 to 0.75 to each other, among them pairs of 0.8 and more: none is lost."""
    draw = random.Random(12)
    base = prose(30, 400).split()

    def changed(words, count):
        words = list(words)
        for at in draw.sample(range(0, len(words) - 6, 6), count):
            words[at] = f"w{draw.randrange(10**9)}"
        return words

    rows = [changed(base, draw.randint(12, 16)) for _ in range(2900)]
    rows += [changed(rows[draw.randrange(2900)], draw.randint(5, 12)) for _ in range(100)]
    sets = [dict(zip(*(x.tolist() for x in dartminhash.shingles(" ".join(r))), strict=True)) for r in rows]
    assert all(set(s.values()) <= {1} for s in sets)  # plain sets, so overlaps are a product
    seen = collections.Counter(e for s in sets for e in s)
    column = {e: n for n, e in enumerate(e for e, c in seen.items() if c > 1)}
    there = np.zeros((len(sets), len(column)), dtype=np.float32)
    for n, s in enumerate(sets):
        there[n, [column[e] for e in s if e in column]] = 1
    both, size = there @ there.T, np.array([len(s) for s in sets])
    alike = both / (size[:, None] + size[None, :] - both) >= 0.8
    parent = list(range(len(sets)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in np.argwhere(np.triu(alike, 1)).tolist():
        parent[root(a)] = root(b)
    least: dict[int, int] = {}
    for n in range(len(sets)):
        least[root(n)] = min(n, least.get(root(n), n))
    frame = spark.createDataFrame([(n, " ".join(r)) for n, r in enumerate(rows)], "doc_id BIGINT, text STRING")
    got = {r.doc_id: r.class_id for r in dartminhash.classes(frame).collect()}
    assert got == {n: least[root(n)] for n in range(len(sets))}
    assert 2850 < len(set(got.values())) < 2960


def test_near_duplicate_edges(edges, nothing):
    got = dartminhash.classes(edges, stored=True).collect()
    by_id = {r.doc_id: r.class_id for r in got}
    assert len(got) == len(document_rows())
    assert by_id[1] == by_id[2] == by_id[3] == 1 and by_id[4] == by_id[5] == by_id[6] == 4
    assert by_id[None] is None and by_id[7] == 7
    kept = dartminhash.one_of_each(edges, stored=True)
    assert kept.columns == edges.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 7, 8, 9, 10, 11, 12]
    assert dartminhash.classes(nothing, stored=True).count() == 0


# ---------------------------------------------------------------- substring dedup


def test_repeated_passages_stay_once(edges, nothing):
    got = {r.doc_id: r for r in linededup.removals(edges, stored=True).collect()}
    before = {r[0]: r[1] for r in document_rows()}
    passage = prose(2, 60) + "."
    inside = [i for i, r in got.items() if r.text and passage in r.text]
    assert inside == [9]
    assert got[1].text == before[1] and got[4].text is None and got[5].text == ""
    assert got[10].text.split() == (prose(7, 40) + " " + prose(8, 20)).split()
    for i, r in got.items():
        kept, at = "", 0
        for span in r.removed:
            kept += before[i][at : span.start]
            at = span.end
        assert (r.text or "") == kept + (before[i] or "")[at:]
        assert r.kept_chars + r.removed_chars == len(before[i] or "")
    both = [r.text for r in linededup.removals(edges, stored=True).collect() if r.doc_id is None]
    assert sorted(map(bool, both)) == [False, True]
    assert linededup.removals(nothing, stored=True).count() == 0


def fifties(text):
    words = (text or "").lower().split()
    return {" ".join(words[n : n + 50]) for n in range(len(words) - 49)}


def test_no_passage_of_fifty_words_stays_shared(spark):
    """By brute force over all windows of 50 words of the driver's documents."""
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    before = sorted((r.doc_id, r.text) for r in docs.collect())
    after = sorted((r.doc_id, r.text) for r in linededup.removals(docs, stored=True).collect())
    shared = []
    for rows in (before, after):
        seen, found = set(), 0
        for _, text in rows:
            own = fifties(text)
            found += bool(own & seen)
            seen |= own
        shared.append(found)
    assert shared[0] > 100 and shared[1] == 0


@pytest.mark.parametrize("end", [".", "", "。"])
def test_a_passage_within_sentences_goes(end):
    """Texts without a stop or a capital around and in the passage, in several scripts."""
    for alphabet in ("abcdefgilmnoprstuvd", "αβγδεζηθικλμνξοπρστυ", "абвгдежзиклмнопрстуф"):
        draw = random.Random(alphabet)
        word = lambda: "".join(draw.choices(alphabet, k=draw.randint(2, 7)))
        missed = 0
        for _ in range(40):
            passage = " ".join(word() for _ in range(60)) + end
            texts = [" ".join([*(word() for _ in range(9)), passage, *(word() for _ in range(9))]) for _ in range(2)]
            first, later = (linededup.digests(t, *linededup.units(t)[:2]).tolist() for t in texts)
            marked = [n for n, d in enumerate(later) if d in set(first)]
            cut = linededup.spans(texts[1], marked, linededup.LEAST)
            rest = "".join(texts[1][: cut[0][0]] + texts[1][cut[-1][1] :]) if cut else texts[1]
            missed += bool(fifties(rest) & fifties(texts[0]))
        assert missed <= 1


def test_marked_units_are_those_of_plain_counting(spark, small):
    """The same rule, walked over all documents in order."""
    seen, want = set(), {}
    for r in sorted(small.collect(), key=lambda r: r.doc_id):
        text = r.text or ""
        starts, ends, words = linededup.units(text)
        units = [" ".join(text[a:b].lower().split()) for a, b in zip(starts, ends, strict=True)]
        fresh = []
        for unit in units:
            fresh.append(unit not in seen)
            seen.add(unit)
        removed, at = 0, 0
        while at < len(units):
            end = at
            while end < len(units) and not fresh[end]:
                end += 1
            if end > at and sum(words[at:end]) >= linededup.LEAST:
                removed += (starts[end] if end < len(units) else len(text)) - starts[at]
            at = end + 1
        want[r.doc_id] = removed
    got = {r.doc_id: r.removed_chars for r in linededup.removals(small, stored=True).collect()}
    assert got == want and any(want.values())


# ---------------------------------------------------------------- mixture


def test_mixture_edges(edges, nothing):
    got = schedule.taken(edges, stored=True).collect()
    assert len(got) == len(document_rows())
    assert all(r.taken <= 3 * r.size and r.taken >= 0 for r in got)
    sizes = collections.Counter()
    for _, text, _, source, *_ in document_rows():
        sizes[source] += len(WORD.findall(text or ""))
    assert sum({(r.source_size, r.target): r.source_size for r in got}.values()) == sum(sizes.values())
    assert schedule.taken(nothing, stored=True).count() == 0
    assert texts(schedule.taken(edges, stored=True)) == sorted(str(r.asDict()) for r in got)


def test_targets_by_repeated_resharing(spark):
    sizes = {"a": 1000, "b": 10, "c": 0, "d": 500, "é": 3, None: 90}
    rows = [(s, n) for s, n in sizes.items()]
    frame = spark.createDataFrame(rows, "source STRING, size BIGINT")
    got = {r.source: r.target for r in schedule.targets(frame).collect()}
    names = ["a", "b", "c", "d", "é", None]
    weight = {s: [1, 2, 3][n % 3] for n, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in names if s not in capped)
        above = {s for s in names if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not above:
            break
        capped |= above
    for s in names:
        assert got[s] == pytest.approx(3 * sizes[s] if s in capped else level * weight[s])


def test_mixed_texts_hold_the_words_taken(small):
    taken = {r.doc_id: r.taken for r in schedule.taken(small, stored=True).collect()}
    words, out = collections.Counter(), schedule.mixed(small, stored=True)
    assert out.columns == small.columns
    full = {r.doc_id: r.text for r in small.collect()}
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.text in full[r.doc_id] and r.n_chars == len(r.text)
    assert words == collections.Counter({i: n for i, n in taken.items() if n})


# ---------------------------------------------------------------- packing


def test_places_hold_each_piece_once():
    for counts in ({7: 1}, {2048: 3, 1: 5000, 1024: 3}, {n: n % 7 for n in range(1, 2049)}):
        counts = {n: c for n, c in counts.items() if c}
        filled: dict[int, list] = collections.defaultdict(list)
        ranks = collections.Counter()
        for length, first, end, each, sequence, place in packing.best_fit(counts, 2048):
            assert first == ranks[length]
            ranks[length] = end
            for n in range(end - first):
                filled[sequence + n // each].append((place + n % each * length, length))
        assert ranks == collections.Counter(counts)
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        needed = -(-sum(n * c for n, c in counts.items()) // 2048)
        assert len(filled) <= max(needed + 1, 1.23 * needed)


def test_packing_round_trip(edges, nothing, small):
    import tokenizers

    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for docs in (edges, small):
        want = collections.Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
            for n, at in enumerate(range(0, len(ids), 2048)):
                part = np.array(ids[at : at + 2048], dtype="<u4")
                want[(r.doc_id, n, at, len(part), zlib.crc32(part.tobytes()))] += 1
        got = packing.pack(docs, TOKENIZER, stored=True).collect()
        assert collections.Counter(tuple(r)[:5] for r in got) == want
        sequences = collections.defaultdict(list)
        for r in got:
            sequences[r.sequence_id].append((r.offset, r.length))
        for parts in sequences.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
    assert packing.pack(nothing, TOKENIZER, stored=True).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, small, tmp_path):
    docs = small
    for number, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, SMALL)
        last = number == len(corpus_pipeline.STAGES) - 1
        assert last or out.columns == small.columns, name
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        assert docs.count()
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()


def test_scores_do_not_depend_on_the_layout(spark):
    """Also where several texts have one doc_id."""
    rows = [(i // 3, f"{prose(i, 40)} {i} !!", 1 if i % 2 else 0) for i in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id BIGINT, text STRING")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id BIGINT, quality INT")
    found = [
        sorted((r.doc_id, r.score) for r in quality.judged(docs.repartition(n, "text"), labels).collect())
        for n in (3, 7)
    ]
    assert found[0] == found[1]


def test_contexts_equal_plain_loops():
    """Sums around each unit, over texts whose words hold letters, marks and both."""
    texts = [r[1] for r in document_rows() if r[1] and len(r[1]) < 5000][:10] + ["a B! c-d ## B! é9é", "x", ""]
    vectors, want = quality.index_vectors(), collections.defaultdict(lambda: np.zeros(quality.WIDTH, dtype=int))
    for text in texts:
        words = text.split()
        ids = [quality._units_of(w) for w in words]
        for i, own in enumerate(ids):
            for j in range(max(0, i - quality.AROUND), min(len(ids), i + quality.AROUND + 1)):
                for unit in own if i != j else ():
                    want[unit] = want[unit] + vectors[list(ids[j])].sum(axis=0, dtype=int)
    found = quality.Contexts()
    for n in range(0, len(texts), 4):  # several rounds add up
        found.add([t.split() for t in texts[n : n + 4]])
    total = found.total()
    for unit in range(quality.UNITS):
        assert np.array_equal(total[unit], want[unit] if unit in want else np.zeros(quality.WIDTH))


def test_products_of_counts():
    keys = [np.array([0, 5, 5, 7]), np.array([2])]
    left, right = np.arange(8.0).reshape(4, 2), np.arange(6.0).reshape(2, 3)
    counts = np.bincount(np.concatenate(keys), minlength=8).reshape(4, 2)
    forth, back = quality._products(keys, 4, 2, left, right)
    assert np.array_equal(forth, counts @ right) and np.array_equal(back, counts.T @ left)
    # too many columns to hold a matrix: the same rows, and columns that do not occur are zero
    wide = 1 << 22
    spread = [np.array([0, 2 * wide + 1, 2 * wide + 1, 3 * wide + 1]), np.array([wide])]
    tall = np.concatenate([right, np.zeros((wide - 2, 3))])
    forth, back = quality._products(spread, 4, wide, left, tall)
    assert np.array_equal(forth, counts @ right) and np.array_equal(back[:2], counts.T @ left)


def test_a_task_of_contexts_holds_little():
    """However many words it reads, and however many of them are different."""
    draw = random.Random(9)
    marks = ["", ".", ",", "!", "?!", "...", ")", '"']
    words = [f"{draw.getrandbits(40):x}{draw.choice(marks)}" for _ in range(300_000)]
    texts = [" ".join(draw.choices(words, k=1000)) for _ in range(450)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    quality._entries()
    quality.units.cache_clear()
    tracemalloc.start()
    try:
        assert sum(part.num_rows for part in quality.contexts(iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < 300e6
    finally:
        tracemalloc.stop()


def test_pooling_and_network_equal_plain_loops():
    draw = np.random.default_rng(1)
    vectors = draw.normal(size=(quality.UNITS + 1, quality.WIDTH)).astype(np.float32)
    net = quality.fit(draw.normal(size=(40, 69)), draw.integers(0, 2, 40), rounds=5)
    for text in ["One two, two!", "x", "a b a b", *[prose(i, 50) for i in range(7)]]:
        words = text.split()
        pooled = sum(vectors[u] for w in words for u in quality._units_of(w)) / len(words)
        got = quality.features(text, vectors)
        assert np.allclose(got[: quality.WIDTH], pooled, atol=1e-4)
        assert got[quality.WIDTH + 1] == pytest.approx(sum(a == b for a, b in zip(words, words[1:])) / len(words))
        hidden = [
            np.tanh(sum((got[i] - net.mean[i]) / net.scale[i] * net.first[i, h] for i in range(69)) + net.bias[h])
            for h in range(len(net.bias))
        ]
        logit = (sum(hidden[h] * net.second[h] for h in range(len(hidden))) + net.shift) / net.temperature
        assert net.probability(got[None])[0] == pytest.approx(1 / (1 + np.exp(-logit)))


@pytest.mark.parametrize("rows", [None, []], ids=["edges", "empty"])
def test_pipeline_on_edge_cases(spark, tmp_path, rows):
    """Every stage takes nulls, repeated rows, long texts, extra columns and empty tables."""
    documents(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)], "doc_id BIGINT, quality INT, toxic INT")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    known = {r[0] for r in (document_rows() if rows is None else rows)}
    assert {r.doc_id for r in got} <= known
    filled = collections.Counter()
    for r in got:
        assert 0 < r.length <= 2048 and 0 <= r.offset <= 2048 - r.length
        filled[r.sequence_id] += r.length
    for sequence, length in filled.items():
        assert length <= 2048
        ends = sorted((r.offset, r.length) for r in got if r.sequence_id == sequence)
        assert [o for o, _ in ends] == [sum(n for _, n in ends[:i]) for i in range(len(ends))]


def test_blank_patterns_find_what_the_plain_ones_do():
    draw = random.Random(3)
    finer = re.compile(rf"(?<=[{linededup._ENDS}])\s+")
    for _ in range(20_000):
        text = "".join(draw.choices(" \t\r\n\x0b 　.!?…aÉЖaz,$4é", k=draw.randint(1, 60)))
        at = draw.randrange(len(text))
        for plain, quick in ((linededup._BREAK, linededup._BLANK_BREAK), (finer, linededup._FINER)):
            assert [g.span() for g in plain.finditer(text, at)] == [g.span() for g in quick.finditer(text, at)]
