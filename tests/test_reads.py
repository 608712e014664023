"""Read operators on a school worked out by hand."""

from __future__ import annotations

from datetime import date

import pytest
from conftest import keyed, make_school, rows

from rollbook import GradeRules
from rollbook import operators as op

SPRING, AUTUMN = "2024春", "2024秋"


def test_users(school):
    assert rows(op.find_users(school, "BOB", "student")) == [
        {"user_id": 3, "username": "bob", "role": "Student"}
    ]
    assert rows(op.find_users(school, "bob", "teacher")) == []
    assert [r["username"] for r in rows(op.users_by_role(school, "STUDENT"))] == ["Ann", "Cy", "bob"]


def test_find_users_for_many_names(spark, school):
    asked = spark.createDataFrame([("BOB",), ("TOM",), ("nobody",)], "n STRING")
    assert [r["user_id"] for r in rows(op.find_users(school, asked, "student"))] == [3]


def test_user_info(school):
    info = keyed(op.user_info(school), "user_id")
    assert len(info) == 6
    assert info[(1,)]["birth_date"] == date(2001, 1, 1) and info[(1,)]["department"] is None
    assert info[(2,)]["department"] == "Math" and info[(2,)]["gender"] is None
    assert info[(0,)]["name"] is None
    assert [r["user_id"] for r in rows(op.user_info(school, "ANN"))] == [1]


def test_grade_listings(school):
    grades = keyed(op.grades_all(school), "student_id", "course_id", "semester")
    assert len(grades) == 5
    assert grades[(1, 20, SPRING)]["score"] is None
    assert grades[(1, 20, SPRING)]["teacher_name"] == "Tom"
    assert len(rows(op.grades_all(school, student_id=3))) == 2
    assert {r["semester"] for r in rows(op.grades_by_semester(school, AUTUMN))} == {AUTUMN}
    assert [r["score"] for r in rows(op.grades_by_semester(school, AUTUMN, student_id=1))] == [60]
    assert len(rows(op.grades_by_course(school, 10, student_id=1))) == 2
    named = rows(op.grades_by_username(school, "BOB"))
    assert len(named) == 2 and {r["student_name"] for r in named} == {"Bob"}


def test_grades_by_many_courses(spark, school):
    wanted = spark.createDataFrame([(20,), (30,), (20,)], "c BIGINT")
    assert len(rows(op.grades_by_course(school, wanted))) == 1


def test_teacher_listings(school):
    assert len(rows(op.teacher_grades(school, 2))) == 4
    assert len(rows(op.teacher_grades(school, 2, semester=SPRING))) == 2
    assert len(rows(op.teacher_grades(school, 2, course_id=10, student_id=3))) == 2
    assert "score" not in op.student_courses(school).columns
    assert len(rows(op.student_courses(school, 1))) == 3
    assert len(rows(op.teacher_sections(school, 2))) == 3
    assert [r["course_id"] for r in rows(op.teacher_sections(school, 2, AUTUMN))] == [10, 20]
    roster = rows(op.section_roster(school, 2, 10, SPRING))
    assert [(r["student_name"], r["gender"]) for r in roster] == [("Ann", "女"), ("Bob", None)]
    assert rows(op.section_roster(school, 2, 20, AUTUMN)) == []


def test_grade_status(school):
    status = keyed(op.grade_status(school), "teacher_id", "course_id", "semester")
    figures = {k: (v["enrolled"], v["graded"], v["pending"], v["complete"]) for k, v in status.items()}
    assert figures == {
        (2, 10, SPRING): (2, 2, 0, True),
        (2, 10, AUTUMN): (2, 1, 1, False),
        (4, 20, SPRING): (1, 0, 1, False),
        (2, 20, AUTUMN): (0, 0, 0, False),
    }
    assert len(rows(op.grade_status(school, teacher_id=4))) == 1
    assert len(rows(op.grade_status(school, semester=AUTUMN))) == 2


def test_credit_summary_counts_a_retaken_course_once(school):
    credits = keyed(op.credit_summary(school), "student_id")
    ann = credits[(1,)]
    assert (ann["total_courses"], ann["passed_courses"], ann["failed_courses"]) == (2, 1, 0)
    assert (ann["earned_credits"], ann["total_attempted_credits"]) == (4, 4)
    assert ann["overall_gpa"] == 1.0
    bob = credits[(3,)]
    assert (bob["total_courses"], bob["failed_courses"], bob["overall_gpa"]) == (1, 1, 0.0)
    cy = credits[(5,)]
    assert (cy["total_courses"], cy["earned_credits"], cy["overall_gpa"]) == (0, 0, None)


def test_credit_summary_follows_its_rules(school):
    rules = GradeRules(pass_mark=61, point_base=0, point_step=1)
    ann = keyed(op.credit_summary(school, 1, rules), "student_id")[(1,)]
    assert (ann["passed_courses"], ann["failed_courses"], ann["overall_gpa"]) == (0, 1, 0.0)


def test_credit_report(school):
    report = keyed(op.credit_report(school), "student_id", "semester")
    assert len(report) == 4
    spring = report[(1, SPRING)]
    assert (spring["courses"], spring["attempted_credits"], spring["failed"]) == (2, 4, 1)
    assert spring["earned_credits"] == 0 and spring["gpa"] == 0.0
    assert report[(3, AUTUMN)]["gpa"] is None


def test_student_overview(school):
    overview = keyed(op.student_overview(school), "student_id")
    ann = overview[(1,)]
    assert (ann["semesters"], ann["courses"], ann["graded"], ann["avg_score"]) == (2, 2, 2, 59.5)
    assert ann["latest_semester"] == AUTUMN
    cy = overview[(5,)]
    assert (cy["semesters"], cy["courses"], cy["graded"], cy["avg_score"]) == (0, 0, 0, None)
    assert cy["latest_semester"] is None


@pytest.mark.parametrize(
    ("filters", "found"),
    [
        ({}, [10, 10, 20, 20, 30]),
        ({"course_id": 30}, [30]),
        ({"course_name": "100%"}, [10, 10]),
        ({"course_name": "T_H"}, [20, 20]),
        ({"course_name": "a%e"}, []),
        ({"teacher_name": "tESS"}, [10, 10, 20]),
        ({"semester": AUTUMN}, [10, 20]),
        ({"semester": AUTUMN, "teacher_name": "tom"}, []),
        ({"min_credits": 0}, [10, 10, 20, 20, 30]),
        ({"max_credits": 0}, [20, 20]),
        ({"min_credits": 4, "max_credits": 5}, [10, 10, 30]),
    ],
)
def test_course_search(school, filters, found):
    assert sorted(r["course_id"] for r in rows(op.course_search(school, **filters))) == found


def test_course_detail(school):
    detail = keyed(op.course_detail(school), "course_id", "semester")
    assert len(detail) == 5
    assert detail[(10, SPRING)]["enrolled"] == 2 and detail[(10, SPRING)]["department"] == "Math"
    assert detail[(20, AUTUMN)]["enrolled"] == 0
    assert detail[(30, None)]["enrolled"] == 0 and detail[(30, None)]["teacher_id"] is None
    assert len(rows(op.course_detail(school, 10))) == 2


def test_system_statistics(school):
    assert rows(op.system_statistics(school)) == [
        {
            "users": 6,
            "students": 3,
            "teachers": 2,
            "admins": 1,
            "courses": 3,
            "sections": 4,
            "enrolments": 5,
            "graded": 3,
            "avg_score": 119 / 3,
        }
    ]


def test_course_statistics(school):
    stats = keyed(op.course_statistics(school), "course_id", "semester")
    assert len(stats) == 4
    spring = stats[(10, SPRING)]
    assert (spring["enrolled"], spring["graded"], spring["passed"], spring["failed"]) == (2, 2, 0, 2)
    assert (spring["max_score"], spring["min_score"], spring["avg_score"]) == (59, 0, 29.5)
    assert stats[(10, AUTUMN)]["pass_rate"] == 1.0
    empty = stats[(20, AUTUMN)]
    assert (empty["sections"], empty["enrolled"], empty["pass_rate"]) == (1, 0, None)
    assert stats[(20, SPRING)]["avg_score"] is None
    assert len(rows(op.course_statistics(school, SPRING, 10))) == 1


def test_semester_statistics(school):
    stats = keyed(op.semester_statistics(school), "semester")
    spring = stats[(SPRING,)]
    assert (spring["sections"], spring["courses"], spring["teachers"]) == (2, 2, 2)
    assert (spring["students"], spring["enrolments"], spring["graded"]) == (2, 3, 2)
    assert spring["pass_rate"] == 0.0
    assert list(keyed(op.semester_statistics(school, AUTUMN), "semester")) == [(AUTUMN,)]


def test_teacher_statistics(school):
    stats = keyed(op.teacher_statistics(school), "teacher_id")
    tess = stats[(2,)]
    assert (tess["sections"], tess["courses"], tess["students"], tess["enrolments"]) == (3, 2, 2, 4)
    assert tess["pass_rate"] == 1 / 3
    uma = stats[(6,)]
    assert (uma["sections"], uma["enrolments"], uma["avg_score"]) == (0, 0, None)
    # a filter on facts keeps the teachers without any; one on teachers does not
    spring = keyed(op.teacher_statistics(school, semester=AUTUMN), "teacher_id")
    assert len(spring) == 3 and spring[(4,)]["sections"] == 0
    assert sorted(keyed(op.teacher_statistics(school, department="MATH"), "teacher_id")) == [(2,), (6,)]


def test_student_statistics(school):
    stats = keyed(op.student_statistics(school), "student_id")
    ann = stats[(1,)]
    assert (ann["enrolments"], ann["graded"], ann["passed"], ann["failed"]) == (3, 2, 1, 1)
    assert (ann["max_score"], ann["min_score"], ann["earned_credits"]) == (60, 59, 4)
    assert stats[(5,)]["enrolments"] == 0 and stats[(5,)]["earned_credits"] == 0
    spring = keyed(op.student_statistics(school, semester=SPRING), "student_id")
    assert len(spring) == 3 and spring[(1,)]["earned_credits"] == 0


def test_text_ids_give_the_same_figures(school, text_school):
    for operator in (
        op.credit_summary,
        op.student_overview,
        op.course_statistics,
        op.teacher_statistics,
        op.grade_status,
        op.course_detail,
    ):
        numbers = [
            {k: f"id{v}" if k.endswith("_id") and v is not None else v for k, v in row.items()}
            for row in rows(operator(school))
        ]
        assert sorted(map(str, numbers)) == sorted(map(str, rows(operator(text_school))))


def test_an_empty_school(spark):
    full = make_school(spark)
    empty = full.with_tables(**{t: getattr(full, t).limit(0) for t in ("tc", "sc", "student", "course")})
    assert rows(op.course_statistics(empty)) == []
    assert rows(op.credit_summary(empty)) == []
    assert rows(op.system_statistics(empty))[0]["avg_score"] is None
