from __future__ import annotations

import os
import sys
from datetime import date

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for folder in (ROOT, os.path.join(ROOT, "tests")):
    if folder not in sys.path:
        sys.path.insert(0, folder)

from rollbook.school import School, schemas  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("rollbook-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def make_school(spark, id_type=None, key=lambda n: n) -> School:
    """A school small enough to work out every figure by hand."""
    spring, autumn = "2024春", "2024秋"
    rows = {
        "users": [
            (key(0), "admin", "admin"),
            (key(1), "Ann", "student"),
            (key(2), "Tess", "teacher"),
            (key(3), "bob", "Student"),
            (key(4), "Tom", "teacher"),
            (key(5), "Cy", "student"),
        ],
        "student": [
            (key(1), "Ann", "女", date(2001, 1, 1)),
            (key(3), "Bob", None, None),
            (key(5), "Cy", "男", date(2002, 2, 2)),
        ],
        "teacher": [
            (key(2), "Tess Ray", "Math", "hello"),
            (key(4), "Tom", "Art", None),
            (key(6), "Uma", "math", None),
        ],
        "course": [
            (key(10), "Algebra 100%", "numbers", 4),
            (key(20), "art_History", None, 0),
            (key(30), "Never offered", "", 5),
        ],
        "tc": [
            (key(2), key(10), spring),
            (key(2), key(10), autumn),
            (key(4), key(20), spring),
            (key(2), key(20), autumn),
        ],
        # student 1 fails course 10, then passes it; student 5 takes nothing
        "sc": [
            (key(1), key(10), spring, key(2), 59),
            (key(1), key(10), autumn, key(2), 60),
            (key(1), key(20), spring, key(4), None),
            (key(3), key(10), spring, key(2), 0),
            (key(3), key(10), autumn, key(2), None),
        ],
    }
    declared = schemas(id_type)
    return School(**{t: spark.createDataFrame(rows[t], declared[t]) for t in rows})


@pytest.fixture(scope="session")
def school(spark) -> School:
    return make_school(spark)


@pytest.fixture(scope="session")
def text_school(spark) -> School:
    """The same with text ids."""
    return make_school(spark, T.StringType(), lambda n: f"id{n}")


def rows(df) -> list[dict]:
    """Rows as dicts, in the order of their text."""
    return sorted((r.asDict() for r in df.collect()), key=lambda r: str(r))


def keyed(df, *columns) -> dict:
    """Rows as dicts by key."""
    return {tuple(r[c] for c in columns): r.asDict() for r in df.collect()}
