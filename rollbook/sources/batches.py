"""Change batches drawn from the school tables, one row or more per table row.

Each holds valid changes along with every kind the operators have to refuse.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from rollbook.school import School
from rollbook.sources.projection import STUDENT_KEY, TEACHER_KEY, Projection, semester_no

_TWICE = "explode(array(1L, 2L)) AS change_seq"


def new_users(school: School, projection: Projection) -> DataFrame:
    """Fresh students and teachers, bad roles, taken ids and names, repeats."""
    customer = projection.source("customer").selectExpr(f"{STUDENT_KEY} AS k", "c_name", "c_mktsegment")
    supplier = projection.source("supplier").selectExpr(f"{TEACHER_KEY} AS k", "s_name")

    def student(seq: str, user_id: str, name: str) -> DataFrame:
        return customer.selectExpr(
            f"{seq} AS change_seq",
            f"{user_id} AS user_id",
            f"concat('{name}', k) AS username",
            "CASE WHEN c_mktsegment = 'BUILDING' THEN 'dean' ELSE 'Student' END AS role",
            "c_name AS name",
            "CASE WHEN k % 3 = 0 THEN '' ELSE '女' END AS gender",
            "CASE k % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN '2005-06' WHEN 2 THEN '2005-06-15 or so'"
            " ELSE '2005-06-15' END AS birth_date",
            "string(NULL) AS department",
            "string(NULL) AS introduction",
        )

    teachers = supplier.selectExpr(
        "k AS change_seq",
        "-k AS user_id",
        "concat('guest', k) AS username",
        "'TEACHER' AS role",
        "s_name AS name",
        "string(NULL) AS gender",
        "'' AS birth_date",
        "'visitors' AS department",
        "'' AS introduction",
    )
    return (
        student("k", "-k", "fresh")
        .union(student("k + 1", "-k", "other"))
        .union(student("-k", "-1000000000000 - k", "FRESH"))
        .union(student("k + 2", "-2000000000000 - k", "STUDENT"))
        .union(student("k + 3", "k", "late"))
        .union(teachers)
    )


def leaving_users(school: School, projection: Projection) -> DataFrame:
    """Accounts in the red, named twice; everybody else under an unknown name."""
    customer = projection.source("customer").selectExpr(f"{STUDENT_KEY} AS k", "c_acctbal AS balance")
    supplier = projection.source("supplier").selectExpr(f"{TEACHER_KEY} AS k", "s_acctbal AS balance")

    def people(source: DataFrame, seq: str, name: str) -> DataFrame:
        return source.selectExpr(
            f"{seq} AS change_seq",
            f"concat(CASE WHEN balance < 0 THEN '{name}' ELSE 'ghost' END, k) AS username",
        )

    return (
        people(customer, "1L", "STUDENT")
        .union(people(customer, "2L", "student"))
        .union(people(supplier, "1L", "Teacher"))
    )


def course_edits(school: School, projection: Projection) -> DataFrame:
    """Two edits of every course, some without a name or out of range, and a new one."""
    first = school.course.selectExpr(
        "course_id * 2 AS change_seq",
        "course_id",
        "CASE WHEN course_id % 7 = 0 THEN NULL WHEN course_id % 7 = 1 THEN ''"
        " ELSE concat(name, ' II') END AS name",
        "description",
        "CASE course_id % 9 WHEN 0 THEN 'many' WHEN 1 THEN '3.5' WHEN 2 THEN '4 '"
        " ELSE string((credits + 3) % 13) END AS credits",
    )
    second = school.course.selectExpr(
        "course_id * 2 + 1 AS change_seq",
        "course_id",
        "concat(name, ' III') AS name",
        "'' AS description",
        "string(credits * 2) AS credits",
    )
    new = school.course.selectExpr(
        "course_id * 2 AS change_seq",
        "-1 - course_id AS course_id",
        "concat('new ', name) AS name",
        "description",
        "string(credits) AS credits",
    )
    return first.union(second).union(new)


def leaving_courses(school: School, projection: Projection) -> DataFrame:
    """Large parts are given up, twice; the others are named by an unknown id."""
    return projection.source("part").selectExpr(
        _TWICE, "CASE WHEN p_size > 40 THEN p_partkey ELSE -1 - p_partkey END AS course_id"
    )


def new_sections(school: School, projection: Projection) -> DataFrame:
    """Every section again, for a later semester, without one and with no such teacher."""
    seq = f"bigint({semester_no('semester')}) AS change_seq"

    def offer(teacher: str, semester: str) -> DataFrame:
        return school.tc.selectExpr(
            seq, f"{teacher} AS teacher_id", "course_id", f"{semester} AS semester"
        )

    return (
        offer("teacher_id", "semester")
        .union(offer("teacher_id", "'2004春'"))
        .union(offer("teacher_id", "''"))
        .union(offer("teacher_id + 1", "semester"))
    )


def leaving_sections(school: School, projection: Projection) -> DataFrame:
    """The sections of one year, twice; the others with no such teacher."""
    return school.tc.selectExpr(
        _TWICE,
        "teacher_id + int(NOT startswith(semester, '1996')) AS teacher_id",
        "course_id",
        "semester",
    )


def new_enrolments(school: School, projection: Projection) -> DataFrame:
    """Every enrolment again, and one in the coming semester of the same course."""
    wanted = school.sc.selectExpr(
        f"bigint({semester_no('semester')}) AS change_seq",
        "CASE WHEN student_id % 13 = 5 THEN concat('ghost', student_id)"
        " WHEN student_id % 13 = 6 THEN concat('teacher', teacher_id)"
        " ELSE concat('Student', student_id) END AS student_username",
        "teacher_id",
        "course_id",
        "semester",
    )
    return wanted.union(projection.in_empty_semester(wanted).select(*wanted.columns))


def drops(school: School, projection: Projection) -> DataFrame:
    """Weak results are dropped, twice; other rows name a semester never taken."""
    return school.sc.selectExpr(
        _TWICE,
        "concat(CASE WHEN student_id % 13 = 6 THEN 'ghost' ELSE 'STUDENT' END, student_id)"
        " AS student_username",
        "course_id",
        "CASE WHEN score < 20 THEN semester ELSE '1990春' END AS semester",
    )


def grade_entries(school: School, projection: Projection) -> DataFrame:
    """Two scores for every enrolment, some out of range, no number or from a stranger."""
    marked = school.sc.withColumnRenamed("score", "old").selectExpr("*", "coalesce(old, 41) AS mark")
    enrolment = ["student_id", "course_id", "semester"]
    first = marked.selectExpr(
        "1L AS change_seq",
        "CASE WHEN student_id % 22 = 0 THEN concat('teacher', teacher_id + 2)"
        " WHEN student_id % 26 = 2 THEN concat('student', student_id)"
        " ELSE concat('TEACHER', teacher_id) END AS teacher_username",
        *enrolment,
        "CASE mark % 17 WHEN 0 THEN 'good' WHEN 1 THEN concat(mark, '.9') WHEN 2 THEN '100.7'"
        " ELSE string(mark * 7 % 121) END AS score",
    )
    second = marked.selectExpr(
        "2L AS change_seq",
        "concat('teacher', teacher_id) AS teacher_username",
        *enrolment,
        "string(mark * 3 % 131) AS score",
    )
    return first.union(second)


def grade_removals(school: School, projection: Projection) -> DataFrame:
    """High scores are withdrawn, twice; other rows name the wrong teacher."""
    return school.sc.selectExpr(
        _TWICE,
        "CASE WHEN score >= 90 THEN teacher_id ELSE teacher_id + 2 END AS teacher_id",
        "student_id",
        "course_id",
        "semester",
    )


def student_edits(school: School, projection: Projection) -> DataFrame:
    """Two profile edits per student, some cleared, unreadable or for strangers."""
    first = school.student.selectExpr(
        "1L AS change_seq",
        "CASE WHEN student_id % 11 = 0 THEN concat('teacher', student_id + 1)"
        " ELSE concat('student', student_id) END AS student_username",
        "CASE WHEN student_id % 3 = 0 THEN 'x' ELSE '女' END AS gender",
        "'2001-02-03' AS birth_date",
    )
    second = school.student.selectExpr(
        "2L AS change_seq",
        "concat('STUDENT', student_id) AS student_username",
        "'' AS gender",
        "CASE student_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'soon' WHEN 2 THEN '2002'"
        " WHEN 3 THEN '2002-03-04 junk' ELSE '2002-03-04' END AS birth_date",
    )
    return first.union(second)


def teacher_edits(school: School, projection: Projection) -> DataFrame:
    """Two profile edits per teacher, some without a department or for strangers."""
    first = school.teacher.selectExpr(
        "1L AS change_seq",
        "CASE WHEN teacher_id % 11 = 0 THEN concat('student', teacher_id + 1)"
        " ELSE concat('teacher', teacher_id) END AS teacher_username",
        "'Physics' AS department",
        "'' AS introduction",
    )
    second = school.teacher.selectExpr(
        "2L AS change_seq",
        "concat('Teacher', teacher_id) AS teacher_username",
        "CASE WHEN teacher_id % 3 = 0 THEN '' ELSE department END AS department",
        "concat('new ', name) AS introduction",
    )
    return first.union(second)
