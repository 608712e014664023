"""Reading school tables and writing snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.school import TABLES, School, schemas

# Tables with a semester are laid out by it: most reports name one.
_PARTITIONED = ("tc", "sc")


# Which folder holds what: one row per table, or per semester of a partitioned one.
_MANIFEST = "table_name STRING, semester STRING, root STRING"


def _manifest(spark: SparkSession, root: str) -> list[Row]:
    """What a snapshot consists of; written last, so a root without it is incomplete."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest").collect()
    except AnalysisException as error:
        raise ValueError(f"{root} holds no complete snapshot") from error


def _in(semesters: Sequence[str | None]) -> Column:
    wanted = F.col("semester").isin([s for s in semesters if s is not None])
    return wanted | F.col("semester").isNull() if None in semesters else wanted


def read_school(spark: SparkSession, root: str, id_type: T.DataType | None = None) -> School:
    """The snapshot stored under ``root``, parts of which may stand in older ones."""
    declared = schemas(id_type)
    rows = _manifest(spark, root)
    frames = {}
    for name in TABLES:
        columns = [field.name for field in declared[name]]
        parts: dict[str, list[str | None]] = {}
        for row in rows:
            if row["table_name"] == name:
                parts.setdefault(row["root"], []).append(row["semester"])
        frames[name] = spark.createDataFrame([], declared[name])
        for number, (folder, semesters) in enumerate(sorted(parts.items())):
            part = spark.read.schema(declared[name]).parquet(f"{folder}/{name}").select(*columns)
            if name in _PARTITIONED:
                part = part.filter(_in(semesters))
            frames[name] = part if number == 0 else frames[name].unionByName(part)
    return School(**frames)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    split_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    predicates: list[str] | None = None,
    in_one_task: bool = False,
    **options: str,
) -> DataFrame:
    """A table of a relational database.

    Read in parallel by a numeric key with its bounds, or, where keys are text, by
    ``predicates``: conditions of which each row meets one, a task each. One task reads
    the whole table only if ``in_one_task`` says so.
    """
    if (split_column is None) != (bounds is None):
        raise ValueError("split_column and bounds go together")
    chosen = [split_column is not None, predicates is not None, in_one_task]
    if sum(chosen) != 1:
        raise ValueError("give one of split_column, predicates and in_one_task")
    if predicates is not None:
        if not predicates:
            raise ValueError("predicates must not be empty")
        return spark.read.jdbc(url, table, predicates=predicates, properties=options)
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split_column is not None:
        reader = reader.options(
            partitionColumn=split_column,
            lowerBound=bounds[0],
            upperBound=bounds[1],
            numPartitions=partitions,
        )
    return reader.load()


def write_snapshot(
    school: School,
    root: str,
    tables: tuple[str, ...] = TABLES,
    base: str | None = None,
    semesters: DataFrame | None = None,
) -> None:
    """Write tables under ``root``, which must not hold them yet.

    ``base`` is the snapshot that the change was made to: tables not named stay where it
    has them. With ``semesters``, a column of the semesters that may differ (an
    ``Outcome`` has them), only these are written of tc and sc, and the others stay too,
    so a small change costs what it changes.

    The old snapshot is never overwritten: its plan is what the new one is read from,
    and a job that fails leaves it as the last complete one. Rows are rebalanced by
    semester first, so that a semester ends in few files and a hot one is split instead
    of passing through one task.
    """
    spark = school.users.sparkSession
    if base is None and (semesters is not None or set(tables) != set(TABLES)):
        raise ValueError("a snapshot of some tables or semesters needs the base of the others")
    old = [] if base is None else _manifest(spark, base)
    touched = None if semesters is None else [row[0] for row in semesters.collect()]
    new: list[tuple[str, str | None, str]] = []
    for name in TABLES:
        before = [tuple(row) for row in old if row["table_name"] == name]
        if name not in tables:
            new += before
            continue
        frame: DataFrame = getattr(school, name)
        path = f"{root}/{name}"
        if name not in _PARTITIONED:
            frame.write.mode("errorifexists").parquet(path)
            new.append((name, None, root))
            continue
        if touched is not None:
            frame = frame.filter(_in(touched))
            new += [row for row in before if row[1] not in touched]
        spread = frame.hint("rebalance", "semester").write.partitionBy("semester")
        spread.mode("errorifexists").parquet(path)
        there = spark.read.schema(frame.schema).parquet(path).select("semester").distinct()
        new += [(name, row["semester"], root) for row in there.collect()]
    manifest = spark.createDataFrame(new, _MANIFEST).coalesce(1)
    manifest.write.mode("errorifexists").parquet(f"{root}/manifest")
