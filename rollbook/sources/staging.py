"""Intermediate tables in the folder that the cluster shares.

The folder is the one in ``spark.checkpoint.dir``: a lost executor costs no
recomputation of what stands there, and the driver and all executors see the same
files. Tables live in one database per application, so that they can be dropped
together, which also deletes their files.
"""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; raises if the session names none."""
    folder = spark.conf.get(_SETTING, "")
    if not folder:
        raise ValueError(f"set {_SETTING} to a folder that the driver and all executors share")
    return folder.rstrip("/")


def _database(spark: SparkSession) -> str:
    return "rollbook_" + spark.conf.get("spark.app.id").replace("-", "_").lower()


def scratch_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted with what the application has staged."""
    database = _database(spark)
    folder = f"{shared_folder(spark)}/{database}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{folder}'")
    return f"{folder}/scratch/{uuid.uuid4().hex}"


def _width(column: Column, kind: T.DataType) -> Column:
    """Bytes that a value takes in memory, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        wide = F.octet_length(column) + 16
    elif isinstance(kind, T.StructType):
        wide = reduce(Column.__add__, [_width(column[f.name], f.dataType) for f in kind], F.lit(8))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        wide = F.octet_length(F.array_join(column, "", "")) + 16 * F.size(column)
    elif isinstance(kind, T.ArrayType) and not isinstance(
        kind.elementType, (T.ArrayType, T.MapType, T.StructType)
    ):
        wide = 8 * F.size(column) + 16
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        wide = F.octet_length(F.to_json(F.struct(column.alias("v"))))
    else:
        return F.lit(8)
    return F.coalesce(F.greatest(wide, F.lit(8)), F.lit(8))


def rows_width(df: DataFrame) -> int:
    """Rows times width: what the frame takes in memory, about, in bytes."""
    wide = reduce(Column.__add__, [_width(df[f.name], f.dataType) for f in df.schema], F.lit(8))
    return df.agg(F.sum(wide.cast("bigint"))).first()[0] or 0


_UNITS = {"": 1, "b": 1, "k": 2**10, "m": 2**20, "g": 2**30, "t": 2**40}


def _broadcast_limit(spark: SparkSession) -> int:
    """The largest size that the session broadcasts by itself; negative if none."""
    sizes = []
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        text = spark.conf.get(key, None)
        found = re.fullmatch(r"(-?\d+)([bkmgt]?)b?", (text or "").strip().lower())
        if found:
            sizes.append(int(found[1]) * _UNITS[found[2]])
    return max(sizes, default=-1)


def _written(df: DataFrame, name: str, plain: bool, light: bool = False) -> str:
    """The name of a new table with these rows."""
    spark = df.sparkSession
    database = _database(spark)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{shared_folder(spark)}/{database}'")
    table = f"{database}.{name}_{uuid.uuid4().hex}"
    options = {"compression": "zstd"}
    if plain or light:
        codec = "none" if plain else "snappy"
        options = {"compression": codec, "parquet.enable.dictionary": "false"}
    df.write.options(**options).saveAsTable(table, format="parquet")
    return table


def _files_size(spark: SparkSession, table: str) -> int:
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS NOSCAN")
    told = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Statistics'").first()
    return int(told["data_type"].split(" ")[0])


def stage(
    df: DataFrame, name: str, plain: bool = False, sized: bool = False, light: bool = False
) -> DataFrame:
    """The same rows, computed once and kept in the shared folder until released.

    The size of the files is what the choice of a broadcast goes by. With ``plain`` they are
    neither compressed nor coded by dictionaries, so that it follows the rows' size in
    memory. ``sized`` is for larger tables that are joined: they are compressed, but if that
    makes files small enough to broadcast of rows that are not, by their number and width,
    they are written again, plainly. ``light`` compresses little: a task that sorts what it
    reads of such a table, before any shuffle, then has no more rows than it can hold.
    """
    spark = df.sparkSession
    table = _written(df, name, plain, light)
    if sized and not plain:
        limit = _broadcast_limit(spark)
        if _files_size(spark, table) <= limit < rows_width(spark.table(table)):
            honest = _written(spark.table(table), name, True)
            spark.sql(f"DROP TABLE {table}")
            table = honest
    return spark.table(table)


def _tables(staged: DataFrame) -> list[str]:
    """The name of the table that a staged frame reads; none if it has no files."""
    database = _database(staged.sparkSession)
    return [f"{database}.{file.split('/')[-2]}" for file in staged.inputFiles()[:1]]


def is_small(staged: DataFrame) -> bool:
    """Whether the files of one staged table are small enough for the session to broadcast."""
    spark = staged.sparkSession
    return all(_files_size(spark, table) <= _broadcast_limit(spark) for table in _tables(staged))


def forget(staged: DataFrame) -> None:
    """Drop one staged table, with its files, that nothing is going to read any more."""
    for table in _tables(staged):
        staged.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")


def release(spark: SparkSession) -> None:
    """Drop what this application has staged, with its files."""
    spark.sql(f"DROP DATABASE IF EXISTS {_database(spark)} CASCADE")


def _at_exit() -> None:
    """Drop the staged tables of a session that is still open when Python ends."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        with contextlib.suppress(Exception):  # the JVM may be gone already
            release(spark)


atexit.register(_at_exit)
