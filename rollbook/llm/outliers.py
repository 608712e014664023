"""Quality rules with robust multivariate outliers: minimum covariance determinant.

Statistics of each text become a vector of rates, drawn a little towards a usual rate so
that short texts do not look odd, and held as whole thousandths. Per language and source
the estimates come from half of the distinct vectors, (n + p + 1) / 2 of n in p dimensions,
so that less than half of a group may be junk, and copies count once. There are several
starts: the vectors nearest the coordinatewise medians, and those nearest each of some
vectors drawn by hash. From each, concentration steps take the mean and covariance of the
nearest half and find the nearest again, as long as that lowers the determinant; the least
determinant is kept. Its distances, scaled to the chi-squared median, give every vector
within the 0.975 quantile a vote in the final mean and covariance. A document is rejected
if its squared Mahalanobis distance by those is beyond the 0.999 quantile. Variances have a
floor, so a statistic that is the same nearly everywhere counts by that floor.

Built-in functions only. The estimates are aggregates over groups whose size does not
matter; medians and shares are exact and need memory for the distinct values only, which
whole thousandths bound.

Defined results: a null text has no words; documents that fail the base rules take no
part in the estimates; in a group of fewer than FEWEST other vectors the method rejects none;
null languages and sources are groups of their own; equal rows are documents of their own.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.shared import SPACE, WORD
from rollbook.sources.staging import stage

#: Fixed by the contract.
WINDOW, MIN_WORDS, MOST_REPEATED = 5, 10, 20
SYMBOLS = "#*$%&|<>"

#: Per coordinate, in thousandths: the expression and the floor of its deviation.
VECTOR = [
    ("1000 * ln((word_chars + 250) / (n_words + 50))", 60.0),
    ("1000 * ln(1 + 20 * n_symbols / (word_chars + 250))", 60.0),
    ("1000 * n_dup_lines / (n_lines + 10)", 60.0),
    ("1000 * n_repeat_words / (n_words + 50)", 60.0),
]
#: Starts a group, and how much of a logarithm a step must take off the determinant.
STARTS, GAIN, FEWEST = 6, 1e-3, 12
#: The median, the 0.975 and the 0.999 quantile of chi-squared with four degrees of freedom.
MIDDLE, NEAR, CUT = 3.356694, 11.143287, 18.466827
#: Makes the covariance of what is within NEAR that of all: 0.975 by the share of six degrees.
WIDER = 1.06446
#: Consistent with the standard deviation of normal rows.
MAD = 1.4826
GROUP = ["lang", "source"]
START = [*GROUP, "start"]


def repeated(words: Column) -> Column:
    """How many words stand in windows that a list of words has twice or more.

    Windows are compared by a hash of their words' hashes. Only lists in which some hash
    occurs twice are sorted: equal hashes then stand side by side.
    """
    each = F.transform(words, lambda w: F.xxhash64(w))
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)

    def window(i: Column, of: Column) -> Column:
        return F.xxhash64(*[F.get(of, i + k) for k in range(WINDOW)])

    # one-element arrays stand for local names: each is computed once for the row
    def named(value: Column, then) -> Column:
        return F.element_at(F.transform(F.array(value), then), 1)

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(
            F.zip_with(hashes, starts, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        )

        def found(pairs: Column) -> Column:
            last = F.size(pairs) - 1
            twice = F.filter(
                pairs,
                lambda p, n: ((n > 0) & (F.get(pairs, n - 1)["h"] == p["h"]))
                | ((n < last) & (F.get(pairs, n + 1)["h"] == p["h"])),
            )
            at = F.sort_array(F.transform(twice, lambda p: p["i"]))
            return named(
                at,
                lambda a: F.aggregate(
                    F.transform(
                        a, lambda i, n: F.least(F.lit(WINDOW), F.coalesce(F.get(a, n + 1) - i, F.lit(WINDOW)))
                    ),
                    F.lit(0),
                    lambda s, n: s + n,
                ),
            )

        return named(placed, found)

    def counted(hashes: Column) -> Column:
        unlike = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(unlike, F.lit(0)).otherwise(covered(hashes))

    def windows(of: Column) -> Column:
        return named(F.transform(starts, lambda i: window(i, of)), counted)

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(named(each, windows))


def statistics(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, lang, source, the base statistics and base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        *GROUP,
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]")).alias("lines"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )
    counted = rows.select(
        "doc_id",
        *GROUP,
        F.size("words").cast("bigint").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated(F.col("words")).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
    )
    few = F.col("n_words") < MIN_WORDS
    many = 100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    return counted.withColumn("base_failed", few | many)


def _coordinates() -> list[str]:
    return [f"x{i}" for i in range(len(VECTOR))]


def _by_group(rows: DataFrame, estimates: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Each row with the estimates of its group, of which there are a few rows."""
    named = estimates.select(
        *[F.col(k).alias(f"_{k}") for k in keys], *[c for c in estimates.columns if c not in keys]
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(named, same, "left").drop(*[f"_{k}" for k in keys])


def _first_distances(rows: DataFrame) -> DataFrame:
    """Rows by start, with the distance from its centre in deviations from the medians."""
    xs = _coordinates()
    drawn = [
        F.min_by(x, F.xxhash64(F.lit(s), *xs)).alias(f"c_{s}_{x}") for s in range(1, STARTS) for x in xs
    ]
    centres = rows.groupBy(*GROUP).agg(*[F.median(x).alias(f"c_0_{x}") for x in xs], *drawn)
    centres = stage(centres, "centres")
    spread = _by_group(rows, centres).groupBy(*GROUP).agg(
        *[F.median(F.abs(F.col(x) - F.col(f"c_0_{x}"))).alias(f"s_{x}") for x in xs]
    )
    listed = F.array(
        *[
            F.struct(F.lit(s).alias("start"), *[F.col(f"c_{s}_{x}").alias(f"m_{x}") for x in xs])
            for s in range(STARTS)
        ]
    )
    begun = stage(centres.select(*GROUP, F.inline(listed)), "begun")
    told = _by_group(_by_group(rows, begun), stage(spread, "spreads"))
    terms = [
        (F.col(x) - F.col(f"m_{x}")) / F.greatest(MAD * F.col(f"s_{x}"), F.lit(floor))
        for x, (_, floor) in zip(xs, VECTOR, strict=True)
    ]
    distance = sum((t * t for t in terms[1:]), terms[0] * terms[0])
    return told.select("start", *rows.columns, distance.alias("d"))


def _nearest(rows: DataFrame) -> DataFrame:
    """Of the rows of each start the half of least distance ``d``, and what ties with it.

    Distances are told apart to a thousandth, and their counts put in order: of those
    there are some tens of thousands at most, whatever the number of rows.
    """
    binned = rows.withColumn("bin", F.floor(1000 * F.log1p("d")))
    counts = binned.groupBy(*START, "bin").agg(F.count("*").alias("many"))
    whole = Window.partitionBy(*START)
    before = F.sum("many").over(whole.orderBy("bin")) - F.col("many")
    half = F.floor((F.sum("many").over(whole) + len(VECTOR) + 1) / 2)
    within = counts.select(*START, "bin", (before < half).alias("within")).filter("within")
    reach = stage(within.groupBy(*START).agg(F.max("bin").alias("reach")), "reaches")
    return _by_group(binned, reach, START).filter("bin <= reach")


def _estimates(near: DataFrame, keys: list[str] = START, wider: float = 1.0) -> DataFrame:
    """Per key: the mean and covariance of its rows, and the logarithm of the determinant."""
    xs = _coordinates()
    sums = [F.count("*").alias("n"), *[F.sum(x).alias(f"t_{x}") for x in xs]]
    pairs = [(i, j) for i in range(len(xs)) for j in range(i + 1)]
    sums += [F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"t_{i}_{j}") for i, j in pairs]
    total = near.groupBy(*keys).agg(*sums)
    mean = [F.col(f"t_{x}") / F.col("n") for x in xs]
    out = [m.alias(f"mean_{x}") for m, x in zip(mean, xs, strict=True)]
    for i, j in pairs:
        floor = VECTOR[i][1] ** 2 if i == j else 0.0
        covered = F.col(f"t_{i}_{j}") / F.col("n") - mean[i] * mean[j]
        out.append((wider * covered + floor).alias(f"c_{i}_{j}"))
    told = _cholesky(total.select(*keys, "n", *out))
    roots = [F.ln(f"l_{i}_{i}") for i in range(len(xs))]
    return told.withColumn("volume", 2 * sum(roots[1:], roots[0]))


def _concentrated(rows: DataFrame) -> DataFrame:
    """Per group the estimates of least determinant that concentration reaches from any start."""
    best = _estimates(_nearest(_first_distances(rows))).withColumn("fresh", F.lit(True))
    best = stage(best, "estimates")
    # each round lowers some determinant by GAIN, and floors bound them all from below
    while not best.filter("fresh").isEmpty():
        again = _estimates(_nearest(_distance(rows, best.filter("fresh"))))
        both = best.withColumn("fresh", F.lit(False)).unionByName(again.withColumn("fresh", F.lit(True)))
        least = Window.partitionBy(*START).orderBy(F.col("volume") + F.when(F.col("fresh"), GAIN).otherwise(0.0), "fresh")
        best = stage(both.withColumn("_n", F.row_number().over(least)).filter("_n = 1").drop("_n"), "estimates")
    first = Window.partitionBy(*GROUP).orderBy("volume", "start")
    chosen = best.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return stage(chosen.drop("_n", "start", "fresh", "volume"), "concentrated")


def _scales(measured: DataFrame) -> DataFrame:
    """Per group: what brings the median of ``d`` to that of chi-squared, and the rows."""
    middle = measured.groupBy(*GROUP).agg(
        F.percentile(F.floor(1000 * F.log1p("d")), 0.5).alias("middle"), F.count("*").alias("others")
    )
    scale = F.expm1(F.col("middle") / 1000) / MIDDLE
    return stage(middle.select(*GROUP, scale.alias("scale"), "others"), "scales")


def _cholesky(groups: DataFrame) -> DataFrame:
    """With the lower triangle l_i_j of the covariance's root."""
    size = len(VECTOR)
    for i in range(size):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            # the floors keep the diagonal positive
            root = F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l_{j}_{j}")
            groups = groups.withColumn(f"l_{i}_{j}", root)
    return groups.drop(*[c for c in groups.columns if c.startswith("c_")])


def _distance(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """Rows with their squared Mahalanobis distance ``d`` by each estimate of their group."""
    keep = [*rows.columns, *[c for c in estimates.columns if c == "start"]]
    told = _by_group(rows, estimates.drop("n", "volume", "fresh"))
    for i, x in enumerate(_coordinates()):
        rest = F.col(x) - F.col(f"mean_{x}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        told = told.withColumn(f"z_{i}", rest / F.col(f"l_{i}_{i}"))
    squares = [F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(len(VECTOR))]
    return told.select(*keep, sum(squares[1:], squares[0]).alias("d"))


def judged(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, its statistics, base_failed, kept, and the scaled distance."""
    told = stage(
        statistics(docs).withColumns(
            {x: F.round(F.expr(e)).cast("double") for x, (e, _) in zip(_coordinates(), VECTOR, strict=True)}
        ),
        "statistics",
    )
    inner = stage(told.filter("NOT base_failed").select(*GROUP, *_coordinates()).distinct(), "vectors")
    raw = _distance(inner, _concentrated(inner))
    close = _by_group(raw, _scales(raw)).filter(F.col("d") <= NEAR * F.greatest("scale", F.lit(1.0)))
    estimates = stage(_estimates(close, GROUP, WIDER).drop("volume"), "reweighted")
    scales = _scales(_distance(inner, estimates))
    final = _by_group(_distance(told, estimates), scales)
    distance = F.col("d") / F.greatest("scale", F.lit(1.0))
    odd = (F.col("others") >= FEWEST) & (distance > CUT)
    return final.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))).alias("kept"),
        distance.alias("distance"),
    )
