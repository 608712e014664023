"""Per-student credit figures, grade-point averages and overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions import marks
from rollbook.functions.filters import opt_eq
from rollbook.rules import DEFAULT_RULES, GradeRules
from rollbook.school import School


def credit_summary(
    school: School, student_id=None, rules: GradeRules = DEFAULT_RULES
) -> DataFrame:
    """Courses, credits and grade-point average per student.

    A course taken several times counts once, with its best score. The
    attempts are reduced to one row per (student, course) before credits are
    looked up, so a retaken course never multiplies them.
    """
    best = (
        opt_eq(school.sc, "student_id", student_id)
        .groupBy("student_id", "course_id")
        .agg(F.max("score").alias("best"))
    )
    figures = (
        best.join(school.course.select("course_id", "credits"), "course_id")
        .groupBy("student_id")
        .agg(
            F.count("*").alias("total_courses"),
            marks.earned_credits(rules, "best").alias("earned_credits"),
            F.sum("credits").alias("total_attempted_credits"),
            marks.gpa(rules, "best").alias("overall_gpa"),
            marks.passed(rules, "best").alias("passed_courses"),
            marks.failed(rules, "best").alias("failed_courses"),
        )
    )
    return (
        opt_eq(school.student, "student_id", student_id)
        .select("student_id")
        .join(figures, "student_id", "left")
        .select(
            "student_id",
            *marks.or_zero("total_courses", "earned_credits", "total_attempted_credits"),
            "overall_gpa",
            *marks.or_zero("passed_courses", "failed_courses"),
        )
    )


def credit_report(
    school: School, student_id=None, rules: GradeRules = DEFAULT_RULES
) -> DataFrame:
    """Credits and grade-point average per student and semester."""
    return (
        opt_eq(school.sc, "student_id", student_id)
        .join(school.course.select("course_id", "credits"), "course_id")
        .groupBy("student_id", "semester")
        .agg(
            F.count("*").alias("courses"),
            F.sum("credits").alias("attempted_credits"),
            marks.earned_credits(rules).alias("earned_credits"),
            marks.passed(rules).alias("passed"),
            marks.failed(rules).alias("failed"),
            marks.gpa(rules).alias("gpa"),
        )
    )


def student_overview(school: School, student_id=None) -> DataFrame:
    """Personal data with enrolment counts, mean score and latest semester.

    Enrolments are aggregated along two paths, by semester and by course, whose
    keys are long before they are narrowed to the student. Counting both kinds
    of distinct values in one aggregate would triple the rows instead, and its
    text maximum would force sort-based aggregation over all of them.
    """
    sc = opt_eq(school.sc, "student_id", student_id)
    by_semester = (
        sc.groupBy("student_id", "semester")
        .agg(F.count("score").alias("graded"), F.sum("score").alias("total"))
        .groupBy("student_id")
        .agg(
            F.count("*").alias("semesters"),
            F.sum("graded").alias("graded"),
            F.sum("total").alias("total"),
            F.max("semester").alias("latest_semester"),
        )
    )
    by_course = sc.groupBy("student_id").agg(F.countDistinct("course_id").alias("courses"))
    return (
        opt_eq(school.student, "student_id", student_id)
        .join(by_semester, "student_id", "left")
        .join(by_course, "student_id", "left")
        .select(
            "student_id",
            "name",
            "gender",
            "birth_date",
            *marks.or_zero("semesters", "courses", "graded"),
            marks.ratio(F.col("total"), F.col("graded")).alias("avg_score"),
            "latest_semester",
        )
    )
