"""Course search and course detail, open to every role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.filters import fuzzy, given, opt_between, opt_eq
from rollbook.functions.marks import or_zero
from rollbook.operators.sections import SECTION_KEY
from rollbook.school import School


def _with_sections(course: DataFrame, sections: DataFrame) -> DataFrame:
    """``course`` left join ``sections`` on course_id, safe for a hot course.

    Adaptive execution cannot split the row-rich right side of a left join. The
    same rows come from an inner join, which it can split on either side, and
    the courses that occur in no section, found against one row per course.
    """
    offered = sections.select("course_id").distinct()
    return course.join(sections, "course_id").unionByName(
        course.join(offered, "course_id", "left_anti"), allowMissingColumns=True
    )


def course_search(
    school: School,
    course_id=None,
    course_name: str | None = None,
    teacher_name: str | None = None,
    semester=None,
    min_credits: int | None = None,
    max_credits: int | None = None,
) -> DataFrame:
    """Courses with their sections; a course without one appears once.

    A teacher or semester filter restricts the result, so it also leaves out
    courses without sections.
    """
    course = fuzzy(opt_eq(school.course, "course_id", course_id), "name", course_name)
    course = opt_between(course, "credits", min_credits, max_credits)
    sections = opt_eq(school.tc, "semester", semester)
    teacher = school.teacher.select("teacher_id", F.col("name").alias("teacher_name"))
    if not given(teacher_name) and not given(semester):
        found = _with_sections(course, sections).join(teacher, "teacher_id", "left")
    elif not given(teacher_name):
        found = course.join(sections, "course_id").join(teacher, "teacher_id", "left")
    else:
        teacher = fuzzy(teacher, "teacher_name", teacher_name)
        found = course.join(sections, "course_id").join(teacher, "teacher_id")
    return found.select(
        "course_id", "name", "description", "credits", "semester", "teacher_id", "teacher_name"
    )


def course_detail(school: School, course_id=None) -> DataFrame:
    """One row per section of the course, with its number of students."""
    course = opt_eq(school.course, "course_id", course_id)
    teacher = school.teacher.select("teacher_id", F.col("name").alias("teacher_name"), "department")
    enrolled = (
        opt_eq(school.sc, "course_id", course_id)
        .groupBy(*SECTION_KEY)
        .agg(F.count("*").alias("enrolled"))
    )
    sections = opt_eq(school.tc, "course_id", course_id).join(enrolled, SECTION_KEY, "left")
    return (
        _with_sections(course, sections)
        .join(teacher, "teacher_id", "left")
        .select(
            "course_id",
            "name",
            "description",
            "credits",
            "semester",
            "teacher_id",
            "teacher_name",
            "department",
            *or_zero("enrolled"),
        )
    )
