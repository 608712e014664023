"""Every operator as a named query over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook import operators as op
from rollbook.functions.filters import fuzzy, with_null_label, with_zero_defaults
from rollbook.operators.changes import Outcome
from rollbook.school import School
from rollbook.sources import batches, read_school, stage, write_snapshot
from rollbook.sources.projection import Projection
from rollbook.sources.staging import scratch_folder

Query = Callable[[SparkSession, str], DataFrame]

# How often a plan reads the enrolments, and the sections derived from them.
ONCE, STAGED, SECTIONS_TOO = "once", "staged", "sections too"


def _school(projection: Projection, reads: str) -> School:
    """The school with the tables staged that the plan would derive several times."""
    if reads == ONCE:
        return projection.school()
    school = projection.school(stage(projection.sc(), "sc", sized=True))
    if reads == SECTIONS_TOO:
        school = school.with_tables(tc=stage(school.tc, "tc", sized=True))
    return school


def _once(operator: Callable[[School], DataFrame]) -> Query:
    return lambda spark, root: operator(_school(Projection(spark, root), ONCE))


def _staged(operator: Callable[[School], DataFrame]) -> Query:
    return lambda spark, root: operator(_school(Projection(spark, root), STAGED))


def _of_semester(semester: str, operator: Callable[[School], DataFrame]) -> Query:
    """The school's enrolments of one semester are all that is derived, once."""

    def run(spark: SparkSession, root: str) -> DataFrame:
        projection = Projection(spark, root)
        kept = projection.sc().filter(F.col("semester") == semester)
        return operator(projection.school(stage(kept, "sc", plain=True)))

    return run


def _with_sections(operator: Callable[[School], DataFrame]) -> Query:
    return lambda spark, root: operator(_school(Projection(spark, root), SECTIONS_TOO))


def _change(operator, batch, output: Callable[[Outcome], DataFrame], reads: str) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        projection = Projection(spark, root)
        school = _school(projection, reads)
        return output(operator(school, batch(school, projection)))

    return run


def _requested_names(school: School) -> DataFrame:
    """The account names of all people, as someone might type them."""
    return school.users.select(F.upper("username").alias("name"))


def _widgets(school: School) -> DataFrame:
    """The courses with widgets in their name."""
    return fuzzy(school.course, "name", "WIDGET").select("course_id")


READS: dict[str, Query] = {
    "find_users": _once(lambda s: op.find_users(s, _requested_names(s), "Student")),
    "users_by_role": _once(lambda s: op.users_by_role(s, "Teacher")),
    "user_info": _once(op.user_info),
    "grades_all": _once(op.grades_all),
    "grades_by_semester": _once(lambda s: op.grades_by_semester(s, "1998春")),
    "grades_by_course": _once(lambda s: op.grades_by_course(s, _widgets(s))),
    "grades_by_username": _once(op.grades_by_username),
    "teacher_grades": _once(op.teacher_grades),
    "teacher_grades_semester": _once(lambda s: op.teacher_grades(s, semester="1999秋")),
    "student_courses": _once(op.student_courses),
    "teacher_sections": _once(op.teacher_sections),
    "section_roster": _once(op.section_roster),
    "grade_status": _staged(op.grade_status),
    "credit_summary": _once(op.credit_summary),
    "credit_report": _once(op.credit_report),
    "student_overview": _staged(op.student_overview),
    "course_search": _with_sections(op.course_search),
    "course_search_filtered": _once(
        lambda s: op.course_search(
            s, course_name="RED", teacher_name="supplier#", min_credits=3, max_credits=8
        )
    ),
    "course_search_blank": _once(
        lambda s: op.course_search(
            s, course_name="", teacher_name="", semester="", min_credits="0", max_credits="4"
        )
    ),
    "course_detail": _with_sections(op.course_detail),
    "system_statistics": _staged(op.system_statistics),
    "course_statistics": _staged(op.course_statistics),
    "course_statistics_semester": _of_semester(
        "2000春", lambda s: op.course_statistics(s, semester="2000春")
    ),
    "semester_statistics": _staged(op.semester_statistics),
    "teacher_statistics": _staged(op.teacher_statistics),
    "teacher_statistics_department": _of_semester(
        "1997秋",
        lambda s: op.teacher_statistics(s, semester="1997秋", department="nation_3"),
    ),
    "student_statistics": _once(op.student_statistics),
    "student_statistics_semester": _once(lambda s: op.student_statistics(s, semester="1996春")),
    "grade_report": _once(lambda s: with_null_label(op.grades_all(s))),
    "credit_card": _once(lambda s: with_zero_defaults(op.credit_summary(s))),
}


# operator, batch, and its outputs: the main table first, with what each one reads
_CHANGES = [
    (op.add_users, batches.new_users, {"users": ONCE, "student": ONCE, "teacher": ONCE, "rejects": ONCE}),
    (
        op.delete_users,
        batches.leaving_users,
        {
            "users": ONCE,
            "student": ONCE,
            "teacher": ONCE,
            "tc": ONCE,
            "sc": ONCE,
            "rejects": ONCE,
            "removed": STAGED,
        },
    ),
    (op.upsert_courses, batches.course_edits, {"course": ONCE, "rejects": ONCE}),
    (
        op.delete_courses,
        batches.leaving_courses,
        {"course": ONCE, "tc": ONCE, "sc": ONCE, "rejects": ONCE, "removed": STAGED},
    ),
    (op.add_sections, batches.new_sections, {"tc": SECTIONS_TOO, "rejects": SECTIONS_TOO}),
    (
        op.delete_sections,
        batches.leaving_sections,
        {"tc": SECTIONS_TOO, "sc": SECTIONS_TOO, "rejects": SECTIONS_TOO, "removed": SECTIONS_TOO},
    ),
    (op.enrol, batches.new_enrolments, {"sc": SECTIONS_TOO, "rejects": SECTIONS_TOO}),
    (op.drop, batches.drops, {"sc": STAGED, "rejects": STAGED}),
    (op.upsert_grades, batches.grade_entries, {"sc": STAGED, "rejects": STAGED}),
    (op.delete_grades, batches.grade_removals, {"sc": STAGED, "rejects": STAGED}),
    (op.update_student_profiles, batches.student_edits, {"student": ONCE, "rejects": ONCE}),
    (op.update_teacher_profiles, batches.teacher_edits, {"teacher": ONCE, "rejects": ONCE}),
]


def _output(name: str) -> Callable[[Outcome], DataFrame]:
    if name in ("rejects", "removed"):
        return lambda outcome: getattr(outcome, name)
    return lambda outcome: getattr(outcome.school, name)


def _change_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for operator, batch, outputs in _CHANGES:
        for position, (name, reads) in enumerate(outputs.items()):
            key = operator.__name__ if position == 0 else f"{operator.__name__}_{name}"
            found[key] = _change(operator, batch, _output(name), reads)
    return found


def _through_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """Enrolments per semester in a snapshot of which only the changed semesters are new."""
    projection, folder = Projection(spark, root), scratch_folder(spark)
    write_snapshot(_school(projection, STAGED), f"{folder}/v1")
    school = read_school(spark, f"{folder}/v1")
    outcome = op.delete_sections(school, batches.leaving_sections(school, projection))
    write_snapshot(
        outcome.school, f"{folder}/v2", ("tc", "sc"), f"{folder}/v1", outcome.semesters
    )
    return read_school(spark, f"{folder}/v2").sc.groupBy("semester").agg(
        F.count("*").alias("enrolments"),
        F.count("score").alias("graded"),
        F.sum("score").alias("score_sum"),
    )


QUERIES: dict[str, Query] = {
    **READS,
    **_change_queries(),
    "snapshot_semesters": _through_snapshots,
}
