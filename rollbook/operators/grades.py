"""Grade listings: enrolments with the names behind their ids.

No join carries a broadcast hint. Catalyst broadcasts a dimension whose size it
knows to be under the session's threshold and otherwise sort-merges, where
adaptive execution splits a hot student, course or teacher.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.filters import opt_eq, opt_eq_text, same_text
from rollbook.school import School

GRADE_COLUMNS = (
    "student_id",
    "course_id",
    "course_name",
    "credits",
    "teacher_name",
    "semester",
    "score",
)


def _named(school: School, sc: DataFrame, course_id=None) -> DataFrame:
    # The course filter sits on the dimension: Catalyst carries a fixed id over to
    # sc, and a DataFrame of ids shrinks the small side, not the shuffled one.
    course = opt_eq(school.course, "course_id", course_id).select(
        "course_id", F.col("name").alias("course_name"), "credits"
    )
    teacher = school.teacher.select("teacher_id", F.col("name").alias("teacher_name"))
    return sc.join(course, "course_id").join(teacher, "teacher_id")


def grades_all(school: School, student_id=None) -> DataFrame:
    """Every enrolment of the student (or of all), ungraded ones included."""
    return _named(school, opt_eq(school.sc, "student_id", student_id)).select(*GRADE_COLUMNS)


def grades_by_semester(school: School, semester, student_id=None) -> DataFrame:
    """Grades of one semester."""
    sc = opt_eq(opt_eq(school.sc, "semester", semester), "student_id", student_id)
    return _named(school, sc).select(*GRADE_COLUMNS)


def grades_by_course(school: School, course_id, student_id=None) -> DataFrame:
    """All attempts at a course, or at each course of a one-column DataFrame."""
    sc = opt_eq(school.sc, "student_id", student_id)
    return _named(school, sc, course_id).select(*GRADE_COLUMNS)


def grades_by_username(school: School, username=None) -> DataFrame:
    """Grades looked up by the student's account name."""
    accounts = opt_eq_text(school.users.filter(same_text("role", "student")), "username", username)
    people = accounts.select(F.col("user_id").alias("student_id"), "username").join(
        school.student.select("student_id", F.col("name").alias("student_name")), "student_id"
    )
    return _named(school, school.sc.join(people, "student_id")).select(
        "username", "student_name", *GRADE_COLUMNS
    )


def teacher_grades(
    school: School, teacher_id=None, semester=None, course_id=None, student_id=None
) -> DataFrame:
    """Grades in a teacher's sections."""
    sc = opt_eq(opt_eq(school.sc, "teacher_id", teacher_id), "semester", semester)
    course = opt_eq(school.course, "course_id", course_id).select(
        "course_id", F.col("name").alias("course_name")
    )
    student = opt_eq(school.student, "student_id", student_id).select(
        "student_id", F.col("name").alias("student_name")
    )
    return (
        sc.join(course, "course_id")
        .join(student, "student_id")
        .select(
            "teacher_id",
            "course_id",
            "course_name",
            "semester",
            "student_id",
            "student_name",
            "score",
        )
    )


def student_courses(school: School, student_id=None) -> DataFrame:
    """The courses a student is enrolled in, without grades."""
    return _named(school, opt_eq(school.sc, "student_id", student_id)).select(
        "student_id",
        "course_id",
        "course_name",
        "credits",
        "teacher_id",
        "teacher_name",
        "semester",
    )
