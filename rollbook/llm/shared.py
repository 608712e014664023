"""What several operators of this package use."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.sources.staging import stage

#: Fixed by the contract: words are what stands between these white-space characters.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"

#: Where a row stands: a hash of its file's path and its number there. Unlike a
#: running number it is the same in every scan and in every repeated task.
ROW = ["row_file", "row_index"]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def numbered(rows: DataFrame, *columns: str, stored: bool = False) -> DataFrame:
    """The columns asked for and ROW, which tells equal rows apart.

    ``stored`` says that the rows are read from parquet files one to one. Others are
    written to the shared folder first, since only files give rows a lasting place.
    """
    if not stored:
        rows = stage(rows.select(*columns), "rows")
    place = rows.metadataColumn("_metadata")
    return rows.select(
        *columns,
        F.xxhash64(place["file_path"]).alias(ROW[0]),
        place["row_index"].alias(ROW[1]),
    )


def fraction(text: Column) -> Column:
    """A number from 0 below 2^31 for each text, even and the same everywhere."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint").bitwiseAND(2**31 - 1)


def chunks_for(rows: int) -> int:
    """So many chunks that neither a chunk nor the list of chunks is long."""
    return 4 * math.isqrt(max(rows, 1)) + 1


def running(
    rows: DataFrame, keys: list[str], chunk: str, order: list, amount: Column, name: str
) -> DataFrame:
    """``amount`` summed over the earlier rows of the same key, as column ``name``.

    A key may hold any share of the rows: its rows are summed by chunk first, and
    only rows of one chunk meet in a task. Chunks have to follow the order.
    """
    rows = rows.withColumn("_amount", amount)
    by_chunk = rows.groupBy(*keys, chunk).agg(F.sum("_amount").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    base = by_chunk.select(
        *[F.col(k).alias(f"_{k}") for k in [*keys, chunk]],
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"),
    )
    same = None
    for k in [*keys, chunk]:
        one = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = one if same is None else same & one
    within = Window.partitionBy(*keys, chunk).orderBy(*order)
    inside = F.coalesce(
        F.sum("_amount").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    return (
        rows.join(base, same)
        .withColumn(name, (F.col("_base") + inside).cast("bigint"))
        .drop("_amount", "_base", *[f"_{k}" for k in [*keys, chunk]])
    )
