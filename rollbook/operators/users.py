"""Accounts and the person behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.functions.filters import opt_eq_text, same_text
from rollbook.school import School


def find_users(school: School, username, role) -> DataFrame:
    """Accounts with this username in this role. No password is carried."""
    found = opt_eq_text(opt_eq_text(school.users, "role", role), "username", username)
    return found.select("user_id", "username", "role")


def users_by_role(school: School, role: str) -> DataFrame:
    """Accounts of one role."""
    return opt_eq_text(school.users, "role", role).select("username", "role")


def user_info(school: School, username=None) -> DataFrame:
    """Each account with its student or teacher record.

    Students and teachers are handled apart, so that an account is shuffled
    once, against the one table that can hold it.
    """
    users = opt_eq_text(school.users, "username", username)
    is_student, is_teacher = same_text("role", "student"), same_text("role", "teacher")
    students = users.filter(is_student).join(
        school.student.withColumnRenamed("student_id", "user_id"), "user_id", "left"
    )
    teachers = users.filter(is_teacher).join(
        school.teacher.withColumnRenamed("teacher_id", "user_id"), "user_id", "left"
    )
    others = users.filter(F.coalesce(~(is_student | is_teacher), F.lit(True)))
    everyone = students.unionByName(teachers, allowMissingColumns=True).unionByName(
        others, allowMissingColumns=True
    )
    return everyone.select(
        "user_id", "username", "role", "name", "gender", "birth_date", "department", "introduction"
    )
