"""Read operators and change-set operators over a :class:`rollbook.School`."""

from rollbook.operators.changes import (
    Outcome,
    add_sections,
    add_users,
    delete_courses,
    delete_grades,
    delete_sections,
    delete_users,
    drop,
    enrol,
    update_student_profiles,
    update_teacher_profiles,
    upsert_courses,
    upsert_grades,
)
from rollbook.operators.courses import course_detail, course_search
from rollbook.operators.credits import credit_report, credit_summary, student_overview
from rollbook.operators.grades import (
    grades_all,
    grades_by_course,
    grades_by_semester,
    grades_by_username,
    student_courses,
    teacher_grades,
)
from rollbook.operators.sections import grade_status, section_roster, teacher_sections
from rollbook.operators.statistics import (
    course_statistics,
    semester_statistics,
    student_statistics,
    system_statistics,
    teacher_statistics,
)
from rollbook.operators.users import find_users, user_info, users_by_role

__all__ = [
    "Outcome",
    "add_sections",
    "add_users",
    "course_detail",
    "course_search",
    "course_statistics",
    "credit_report",
    "credit_summary",
    "delete_courses",
    "delete_grades",
    "delete_sections",
    "delete_users",
    "drop",
    "enrol",
    "find_users",
    "grade_status",
    "grades_all",
    "grades_by_course",
    "grades_by_semester",
    "grades_by_username",
    "section_roster",
    "semester_statistics",
    "student_courses",
    "student_overview",
    "student_statistics",
    "system_statistics",
    "teacher_grades",
    "teacher_sections",
    "teacher_statistics",
    "update_student_profiles",
    "update_teacher_profiles",
    "upsert_courses",
    "upsert_grades",
    "user_info",
    "users_by_role",
]
