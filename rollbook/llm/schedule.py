"""Mixing sources to target weights by a low-discrepancy schedule.

Time is cut into slots of ``block`` words each. Slot i stands at the point
frac(i * golden ratio), and the source whose stretch of the cumulative targets covers
the point gets the slot. A source's k-th slot takes the k-th block of its stream: its
documents one after another, in an order drawn anew for each of up to ``REPEATS``
rounds, cut into blocks of equal size. Because golden-ratio points fill every stretch
evenly, each source is near its share after any number of slots, not only at the end.

Defined results: a null text has no words; a document without words is never taken;
null is a source of its own, the last one; an empty table gives no rows; equal rows are
documents of their own. No other column is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.shared import ROW, SPACE, WORD, chunks_for, fraction, numbered, running
from rollbook.sources.staging import stage

#: Fixed by the contract: weights of the sources in their order, and the most rounds.
WEIGHTS = [1, 2, 3]
REPEATS = 3
#: 2^31 / golden ratio, made odd: multiples of it modulo 2^31 are the slots' points.
STEP = 1327217885
CIRCLE = 2**31
#: Stretches of the circle are found through cells of this width.
CELL = 2**19


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: its size, its target and its stretch [low, high) of the circle.

    All words are shared out by weight, and no source gets more than REPEATS times
    what it has. With L the level at which the targets min(cap, L * weight) make up
    the whole, L is the largest of (whole - caps so far) / (weights not yet capped)
    over the sources in the order of cap / weight. One row per source: a dimension.
    """
    source = Window.orderBy(F.col("source").asc_nulls_last())
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = totals.withColumn("_n", F.row_number().over(source)).withColumn(
        "_weight",
        F.element_at(
            F.array(*[F.lit(float(w)) for w in WEIGHTS]),
            ((F.col("_n") - 1) % len(WEIGHTS) + 1).cast("int"),
        ),
    )
    cap = F.col("source_size").cast("double") * REPEATS
    early = (
        Window.orderBy(cap / F.col("_weight"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    )
    everything = Window.partitionBy()
    whole = F.sum(F.col("source_size").cast("double")).over(everything)
    level = (whole - F.coalesce(F.sum(cap).over(early), F.lit(0.0))) / (
        F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(early), F.lit(0.0))
    )
    levelled = weighed.withColumn("_whole", whole).withColumn("_level", level)
    shared = levelled.withColumn(
        "target", F.least(cap, F.max("_level").over(everything) * F.col("_weight"))
    )
    upto = Window.orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    edge = F.floor(F.sum("target").over(upto) / F.sum("target").over(everything) * CIRCLE)
    last = F.col("_n") == F.max("_n").over(everything)
    stretched = shared.withColumn("high", F.when(last, F.lit(CIRCLE)).otherwise(edge).cast("bigint"))
    low = F.coalesce(F.lag("high").over(Window.orderBy("_n")), F.lit(0)).cast("bigint")
    return stretched.select("source", "source_size", "target", low.alias("low"), "high")


def slots(plan: DataFrame, words: int, block: int) -> DataFrame:
    """Per slot: its source and its rank among that source's slots."""
    spark = plan.sparkSession
    count = -(-words // block)
    chunk = max(1, -(-count // chunks_for(count)))
    points = spark.range(count).select(
        F.col("id").alias("slot"),
        F.expr(f"id div {chunk}").alias("chunk"),
        ((F.col("id") % CIRCLE) * STEP % CIRCLE).alias("point"),
    )
    reach = F.sequence(F.expr(f"low div {CELL}"), F.expr(f"(high - 1) div {CELL}"))
    cells = plan.filter("high > low").select("source", "low", "high", F.explode(reach).alias("cell"))
    owned = points.withColumn("cell", F.expr(f"point div {CELL}")).join(cells, "cell")
    owned = owned.filter("point >= low AND point < high").select("source", "slot", "chunk")
    return running(owned, ["source"], "chunk", ["slot"], F.lit(1), "rank").drop("chunk")


def mix(docs: DataFrame, block: int = 128, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """The schedule, and the documents with their sizes and targets.

    The schedule has a row for each piece of a document in a slot: slot, source, rank
    (the slot's among its source's, and so the block's), the document's ROW and doc_id,
    round (from 0), first_word and end_word. Documents: ROW, doc_id, size, source,
    source_size, target.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = stage(
        numbered(docs, "doc_id", "source", "text", stored=stored).select(
            *ROW, "doc_id", "source", words.alias("size")
        ),
        "sizes",
    )
    plan = stage(targets(sized), "targets")
    rows, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    known = sized.join(
        plan.select(F.col("source").alias("_source"), "source_size", "target"),
        F.col("source").eqNullSafe(F.col("_source")),
    ).drop("_source")
    scheduled = slots(plan, total, block)

    chunk = chunks_for(rows)
    rounds = known.filter("size > 0").withColumn(
        "round", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1)))
    )
    # a round is drawn only if the targets, with a slot or two to spare, reach into it
    rounds = rounds.filter(F.col("round") * F.col("source_size") < F.col("target") + 8 * block)
    drawn = rounds.withColumn(
        "_draw", F.concat_ws(":", "round", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    )
    drawn = drawn.withColumn("_key", fraction(F.col("_draw"))).withColumn(
        "chunk", F.shiftright(F.col("_key") * chunk, 31)
    )
    placed = running(
        drawn, ["source", "round"], "chunk", ["_key", "_draw", "size", *ROW], F.col("size"), "before"
    )
    start = F.col("round") * F.col("source_size") + F.col("before")
    begun = placed.select(*ROW, "doc_id", "source", "round", "size", start.alias("start"))
    blocks = F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))
    pieces = begun.withColumn("rank", F.explode(blocks))
    first = F.greatest(F.lit(0), F.col("rank") * block - F.col("start"))
    end = F.least(F.col("size"), (F.col("rank") + 1) * block - F.col("start"))
    wanted = scheduled.select(F.col("source").alias("_source"), F.col("rank").alias("_rank"), "slot")
    met = (F.col("rank") == F.col("_rank")) & F.col("source").eqNullSafe(F.col("_source"))
    schedule = pieces.join(wanted, met).select(
        "slot",
        "source",
        "rank",
        *ROW,
        "doc_id",
        "round",
        first.cast("bigint").alias("first_word"),
        end.cast("bigint").alias("end_word"),
    )
    return schedule, known


def taken(docs: DataFrame, block: int = 128, stored: bool = False) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes."""
    schedule, known = mix(docs, block, stored)
    counts = schedule.groupBy(*ROW).agg(F.sum(F.expr("end_word - first_word")).alias("taken"))
    return known.join(counts, ROW, "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
    )


def mixed(docs: DataFrame, block: int = 128, stored: bool = False) -> DataFrame:
    """The documents as the mix takes them, one row per document and round.

    The columns are those of ``docs``. Where a round ends inside a document, its text
    is cut after the last word taken and n_chars, if there is such a column, counts anew.
    """
    if not stored:
        docs = stage(docs, "documents")
    schedule, _ = mix(docs, block, stored=True)
    spans = schedule.groupBy(*ROW, "round").agg(
        F.min("first_word").alias("_first"), F.max("end_word").alias("_end")
    )
    spans = spans.select(*[F.col(c).alias(f"_{c}") for c in ROW], "_first", "_end")
    place = docs.metadataColumn("_metadata")
    both = (F.xxhash64(place["file_path"]) == F.col(f"_{ROW[0]}")) & (
        place["row_index"] == F.col(f"_{ROW[1]}")
    )
    parts = F.regexp_extract_all("text", F.lit(f"{WORD}[{SPACE}]*"), F.lit(0))
    cut = F.array_join(F.slice(parts, (F.col("_first") + 1).cast("int"), (F.col("_end") - F.col("_first")).cast("int")), "")
    whole = (F.col("_first") == 0) & (F.col("_end") == F.size(parts))
    text = F.when(whole, F.col("text")).otherwise(cut)
    out = {c: docs[c] for c in docs.columns} | {"text": text}
    if "n_chars" in out:
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return docs.join(spans, both).select(*[e.alias(c) for c, e in out.items()])
