"""Statistics by course, semester, teacher, student and for the whole system.

Sections and enrolments are always aggregated apart and joined afterwards, so
neither side multiplies the other and only one row per group is joined.
Filters on facts run before the outer joins: entities without rows stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions import marks
from rollbook.functions.filters import opt_eq, opt_eq_text, same_text
from rollbook.rules import DEFAULT_RULES, GradeRules
from rollbook.school import School


def system_statistics(school: School) -> DataFrame:
    """One row of totals; each table is counted by its own scalar subquery."""

    def rows(df: DataFrame):
        return df.agg(F.count("*")).scalar()

    accounts = school.users.agg(
        F.count("*").alias("users"),
        F.count_if(same_text("role", "student")).alias("students"),
        F.count_if(same_text("role", "teacher")).alias("teachers"),
        F.count_if(same_text("role", "admin")).alias("admins"),
    )
    return accounts.select(
        "*",
        rows(school.course).alias("courses"),
        rows(school.tc).alias("sections"),
        rows(school.sc).alias("enrolments"),
        school.sc.agg(F.count("score")).scalar().alias("graded"),
        school.sc.agg(F.avg("score")).scalar().alias("avg_score"),
    )


def course_statistics(
    school: School, semester=None, course_id=None, rules: GradeRules = DEFAULT_RULES
) -> DataFrame:
    """Per course and semester in which it has a section."""
    key = ["course_id", "semester"]

    def wanted(df: DataFrame) -> DataFrame:
        return opt_eq(opt_eq(df, "semester", semester), "course_id", course_id)

    offered = wanted(school.tc).groupBy(*key).agg(F.count("*").alias("sections"))
    results = (
        wanted(school.sc)
        .groupBy(*key)
        .agg(
            F.count("*").alias("enrolled"),
            F.count("score").alias("graded"),
            F.avg("score").alias("avg_score"),
            F.max("score").alias("max_score"),
            F.min("score").alias("min_score"),
            marks.passed(rules).alias("passed"),
            marks.failed(rules).alias("failed"),
        )
    )
    course = school.course.select("course_id", F.col("name").alias("course_name"))
    return (
        offered.join(results, key, "left")
        .join(course, "course_id")
        .select(
            "course_id",
            "course_name",
            "semester",
            "sections",
            *marks.or_zero("enrolled", "graded"),
            "avg_score",
            "max_score",
            "min_score",
            *marks.or_zero("passed", "failed"),
            marks.ratio(F.col("passed"), F.col("graded")).alias("pass_rate"),
        )
    )


def semester_statistics(
    school: School, semester=None, rules: GradeRules = DEFAULT_RULES
) -> DataFrame:
    """Per semester that has a section."""
    offered = (
        opt_eq(school.tc, "semester", semester)
        .groupBy("semester")
        .agg(
            F.count("*").alias("sections"),
            F.countDistinct("course_id").alias("courses"),
            F.countDistinct("teacher_id").alias("teachers"),
        )
    )
    results = (
        opt_eq(school.sc, "semester", semester)
        .groupBy("semester")
        .agg(
            F.countDistinct("student_id").alias("students"),
            F.count("*").alias("enrolments"),
            F.count("score").alias("graded"),
            F.avg("score").alias("avg_score"),
            marks.passed(rules).alias("passed"),
        )
    )
    return offered.join(results, "semester", "left").select(
        "semester",
        "sections",
        "courses",
        "teachers",
        *marks.or_zero("students", "enrolments", "graded"),
        "avg_score",
        marks.ratio(F.col("passed"), F.col("graded")).alias("pass_rate"),
    )


def teacher_statistics(
    school: School,
    semester=None,
    teacher_id=None,
    department: str | None = None,
    rules: GradeRules = DEFAULT_RULES,
) -> DataFrame:
    """Per teacher, including those without a section."""

    def wanted(df: DataFrame) -> DataFrame:
        return opt_eq(opt_eq(df, "semester", semester), "teacher_id", teacher_id)

    offered = (
        wanted(school.tc)
        .groupBy("teacher_id")
        .agg(F.count("*").alias("sections"), F.countDistinct("course_id").alias("courses"))
    )
    results = (
        wanted(school.sc)
        .groupBy("teacher_id")
        .agg(
            F.countDistinct("student_id").alias("students"),
            F.count("*").alias("enrolments"),
            F.count("score").alias("graded"),
            F.avg("score").alias("avg_score"),
            marks.passed(rules).alias("passed"),
        )
    )
    teacher = opt_eq_text(opt_eq(school.teacher, "teacher_id", teacher_id), "department", department)
    return (
        teacher.join(offered, "teacher_id", "left")
        .join(results, "teacher_id", "left")
        .select(
            "teacher_id",
            F.col("name").alias("teacher_name"),
            "department",
            *marks.or_zero("sections", "courses", "students", "enrolments", "graded"),
            "avg_score",
            marks.ratio(F.col("passed"), F.col("graded")).alias("pass_rate"),
        )
    )


def student_statistics(
    school: School, student_id=None, semester=None, rules: GradeRules = DEFAULT_RULES
) -> DataFrame:
    """Per student, including those without an enrolment.

    Rows are counted per attempt; earned credits use the best attempt at each
    course. One pass serves both: attempts are first reduced per (student,
    course), then credits are joined and the students summed up.
    """
    sc = opt_eq(opt_eq(school.sc, "student_id", student_id), "semester", semester)
    per_course = sc.groupBy("student_id", "course_id").agg(
        F.count("*").alias("enrolments"),
        F.count("score").alias("graded"),
        F.sum("score").alias("total"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
        marks.passed(rules).alias("passed"),
        marks.failed(rules).alias("failed"),
    )
    figures = (
        per_course.join(school.course.select("course_id", "credits"), "course_id")
        .groupBy("student_id")
        .agg(
            *(F.sum(c).alias(c) for c in ("enrolments", "graded", "total", "passed", "failed")),
            F.max("max_score").alias("max_score"),
            F.min("min_score").alias("min_score"),
            marks.earned_credits(rules, "max_score").alias("earned_credits"),
        )
    )
    student = opt_eq(school.student, "student_id", student_id)
    return (
        student.select("student_id", F.col("name").alias("student_name"))
        .join(figures, "student_id", "left")
        .select(
            "student_id",
            "student_name",
            *marks.or_zero("enrolments", "graded"),
            marks.ratio(F.col("total"), F.col("graded")).alias("avg_score"),
            "max_score",
            "min_score",
            *marks.or_zero("passed", "failed", "earned_credits"),
        )
    )
