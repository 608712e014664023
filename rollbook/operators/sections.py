"""A teacher's sections, their rosters and the state of grade entry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.filters import opt_eq
from rollbook.functions.marks import or_zero
from rollbook.school import School

SECTION_KEY = ["teacher_id", "course_id", "semester"]


def teacher_sections(school: School, teacher_id=None, semester=None) -> DataFrame:
    """Sections with the course's name and credits."""
    tc = opt_eq(opt_eq(school.tc, "teacher_id", teacher_id), "semester", semester)
    course = school.course.select("course_id", F.col("name").alias("course_name"), "credits")
    return tc.join(course, "course_id").select(
        "teacher_id", "course_id", "course_name", "credits", "semester"
    )


def section_roster(school: School, teacher_id=None, course_id=None, semester=None) -> DataFrame:
    """The students of a section."""
    sc = opt_eq(opt_eq(school.sc, "teacher_id", teacher_id), "course_id", course_id)
    sc = opt_eq(sc, "semester", semester)
    student = school.student.select("student_id", F.col("name").alias("student_name"), "gender")
    return sc.join(student, "student_id").select(
        *SECTION_KEY, "student_id", "student_name", "gender"
    )


def grade_status(school: School, teacher_id=None, semester=None) -> DataFrame:
    """Enrolled, graded and pending students per section, empty ones included.

    Enrolments are counted before the join: what meets the sections is one row
    per section, however many students a section has.
    """

    def wanted(df: DataFrame) -> DataFrame:
        return opt_eq(opt_eq(df, "teacher_id", teacher_id), "semester", semester)

    counted = (
        wanted(school.sc)
        .groupBy(*SECTION_KEY)
        .agg(F.count("*").alias("enrolled"), F.count("score").alias("graded"))
    )
    return (
        wanted(school.tc)
        .join(counted, SECTION_KEY, "left")
        .select(*SECTION_KEY, *or_zero("enrolled", "graded"))
        .withColumn("pending", F.col("enrolled") - F.col("graded"))
        .withColumn("complete", (F.col("enrolled") > 0) & (F.col("pending") == 0))
    )
