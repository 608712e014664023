"""The six tables every operator works on."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class School:
    """One snapshot of the school tables.

    Keys: ``users.user_id`` (and ``username``, ignoring case),
    ``student.student_id`` and ``teacher.teacher_id`` (both equal to the
    user's ``user_id``), ``course.course_id``, all three columns of ``tc``, and
    ``(student_id, course_id, semester)`` of ``sc``.
    """

    users: DataFrame
    student: DataFrame
    teacher: DataFrame
    course: DataFrame
    tc: DataFrame
    sc: DataFrame

    def with_tables(self, **tables: DataFrame) -> School:
        """The same snapshot with some tables replaced."""
        return replace(self, **tables)


TABLES = tuple(f.name for f in fields(School))


def schemas(id_type: T.DataType | None = None) -> dict[str, T.StructType]:
    """Declared schema per table; ids are BIGINT unless ``id_type`` says else."""
    key = id_type or T.LongType()
    text, number, day = T.StringType(), T.IntegerType(), T.DateType()
    columns = {
        "users": [("user_id", key), ("username", text), ("role", text)],
        "student": [("student_id", key), ("name", text), ("gender", text), ("birth_date", day)],
        "teacher": [("teacher_id", key), ("name", text), ("department", text), ("introduction", text)],
        "course": [("course_id", key), ("name", text), ("description", text), ("credits", number)],
        "tc": [("teacher_id", key), ("course_id", key), ("semester", text)],
        "sc": [
            ("student_id", key),
            ("course_id", key),
            ("semester", text),
            ("teacher_id", key),
            ("score", number),
        ],
    }
    return {
        table: T.StructType([T.StructField(name, kind) for name, kind in cols])
        for table, cols in columns.items()
    }
