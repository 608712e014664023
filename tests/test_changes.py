"""Change-set operators against a plain walk over the changes.

The walk keeps tables as lists of dicts and looks at one change at a time. Batches
are drawn at random (fixed seeds) from a key space small enough to collide often.
"""

from __future__ import annotations

import random
from datetime import date

import pytest
from conftest import make_school

from rollbook import operators as op
from rollbook.school import TABLES
from rollbook.sources import stage

SPRING, AUTUMN, LATER = "2024春", "2024秋", "2025春"
SEEDS = [1, 2]


@pytest.fixture(params=["small batch", "large batch"], autouse=True)
def batch_size(request, spark):
    """Both ways of looking things up: with and without a batch known to be small."""
    if request.param == "large batch":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plain(df) -> list[dict]:
    return [r.asDict() for r in df.collect()]


def tables_of(school) -> dict[str, list[dict]]:
    return {name: plain(getattr(school, name)) for name in TABLES}


def same(found: list[dict], expected: list[dict]) -> None:
    order = lambda r: str(sorted(r.items(), key=lambda kv: kv[0]))
    assert sorted(found, key=order) == sorted(expected, key=order)


def frame(spark, schema: str, changes: list[dict]):
    names = [part.split()[0] for part in schema.split(", ")]
    local = spark.createDataFrame([tuple(c[n] for n in names) for c in changes], schema)
    return stage(local, "batch")  # read from a file, so that its size is known


def walk(changes, reason, key, last=False):
    """Winners by key, and rejects; ``reason`` gives None for a valid change."""
    winners, rejects = {}, []
    # a change delivered twice is one change
    changes = [c for n, c in enumerate(changes) if c not in changes[:n]]
    for change in changes:
        if reason(change) is None:
            old = winners.get(key(change))
            if old is None or (change["change_seq"] > old["change_seq"]) == last:
                winners[key(change)] = change
    for change in changes:
        why = reason(change)
        if why is None and winners[key(change)] != change:
            why = "superseded"
        if why is not None:
            rejects.append({**change, "reason": why})
    assert len(winners) + len(rejects) == len(changes)
    return winners, rejects


def drawn(seed: int, count: int, **choices) -> list[dict]:
    """Random changes in random order of arrival, one of them delivered twice."""
    rng = random.Random(seed)
    changes = [
        {"change_seq": n, **{name: rng.choice(values) for name, values in choices.items()}}
        for n in range(count)
    ]
    rng.shuffle(changes)
    return [*changes, changes[0]]


def accounts(tables, role):
    return {
        u["username"].lower(): u["user_id"] for u in tables["users"] if u["role"].lower() == role
    }


def low(text):
    return None if text is None else text.lower()


def number(text):
    try:
        return int(text)
    except (TypeError, ValueError):
        return None


def check(outcome, tables, expected, rejects, walked_removed=None):
    """Compare the changed tables, the untouched ones and the rejects."""
    new = tables_of(outcome.school)
    for name in TABLES:
        same(new[name], expected.get(name, tables[name]))
    same(plain(outcome.rejects), rejects)
    if walked_removed is not None:
        same(plain(outcome.removed), walked_removed)


def long_form(table, row):
    keys = ("username", "student_id", "teacher_id", "course_id", "semester")
    return {"table_name": table, **{k: row.get(k) for k in keys}}


NAMES = ["Ann", "ANN", "bob", "Cy", "tess", "Tom", "nobody", "", None]


@pytest.mark.parametrize("seed", SEEDS)
def test_upsert_grades(spark, school, seed):
    tables = tables_of(school)
    changes = drawn(
        seed, 150, teacher_username=["Tess", "TESS", "tom", "Ann", "nobody", None], student_id=[1, 3, 5],
        course_id=[10, 20, None], semester=[SPRING, AUTUMN], score=["0", "59", "100", "101", "-1", "x", "", None],
    )
    teachers = accounts(tables, "teacher")
    place = {(r["student_id"], r["course_id"], r["semester"]): r for r in tables["sc"]}
    key = lambda c: (c["student_id"], c["course_id"], c["semester"])

    def reason(c):
        value = number(c["score"])
        if value is None or not 0 <= value <= 100:
            return "invalid_value"
        teacher = teachers.get(low(c["teacher_username"]))
        if teacher is None:
            return "unknown_user"
        if key(c) not in place or place[key(c)]["teacher_id"] != teacher:
            return "no_such_row"
        return None

    won, rejects = walk(changes, reason, key, last=True)
    sc = [{**r, "score": int(won[k]["score"])} if k in won else r for k, r in place.items()]
    schema = (
        "change_seq BIGINT, teacher_username STRING, student_id BIGINT, course_id BIGINT, "
        "semester STRING, score STRING"
    )
    outcome = op.upsert_grades(school, frame(spark, schema, changes))
    assert won and {r["reason"] for r in rejects} == {
        "invalid_value", "unknown_user", "no_such_row", "superseded",
    }
    check(outcome, tables, {"sc": sc}, rejects)
    # the same batch once more changes nothing
    again = op.upsert_grades(outcome.school, frame(spark, schema, changes))
    same(plain(again.school.sc), sc)


def test_scores_may_be_numbers(spark, school):
    schema = (
        "change_seq BIGINT, teacher_username STRING, student_id BIGINT, course_id BIGINT, "
        "semester STRING, score INT"
    )
    changes = spark.createDataFrame([(1, "tess", 3, 10, AUTUMN, 77)], schema)
    outcome = op.upsert_grades(school, changes)
    assert outcome.rejects.count() == 0
    assert outcome.school.sc.filter("score = 77").count() == 1


@pytest.mark.parametrize("seed", SEEDS)
def test_delete_grades(spark, school, seed):
    tables = tables_of(school)
    changes = drawn(
        seed, 60, teacher_id=[2, 4, None], student_id=[1, 3], course_id=[10, 20], semester=[SPRING, AUTUMN]
    )
    place = {(r["student_id"], r["course_id"], r["semester"], r["teacher_id"]): r for r in tables["sc"]}
    key = lambda c: (c["student_id"], c["course_id"], c["semester"], c["teacher_id"])
    won, rejects = walk(changes, lambda c: None if key(c) in place else "no_such_row", key)
    sc = [{**r, "score": None} if k in won else r for k, r in place.items()]
    schema = "change_seq BIGINT, teacher_id BIGINT, student_id BIGINT, course_id BIGINT, semester STRING"
    check(op.delete_grades(school, frame(spark, schema, changes)), tables, {"sc": sc}, rejects)


@pytest.mark.parametrize("seed", SEEDS)
def test_enrol(spark, school, seed):
    tables = tables_of(school)
    changes = drawn(
        seed, 150, student_username=NAMES, teacher_id=[2, 4, None], course_id=[10, 20, 30],
        semester=[SPRING, AUTUMN, LATER],
    )
    students = accounts(tables, "student")
    sections = {(r["teacher_id"], r["course_id"], r["semester"]) for r in tables["tc"]}
    taken = {(r["student_id"], r["course_id"], r["semester"]) for r in tables["sc"]}
    key = lambda c: (students.get(low(c["student_username"])), c["course_id"], c["semester"])

    def reason(c):
        if low(c["student_username"]) not in students:
            return "unknown_user"
        if (c["teacher_id"], c["course_id"], c["semester"]) not in sections:
            return "no_such_row"
        return "duplicate" if key(c) in taken else None

    won, rejects = walk(changes, reason, key)
    added = [
        dict(zip(("student_id", "course_id", "semester"), k)) | {"teacher_id": c["teacher_id"], "score": None}
        for k, c in won.items()
    ]
    schema = "change_seq BIGINT, student_username STRING, teacher_id BIGINT, course_id BIGINT, semester STRING"
    assert added and {r["reason"] for r in rejects} == {
        "unknown_user", "no_such_row", "duplicate", "superseded",
    }
    check(op.enrol(school, frame(spark, schema, changes)), tables, {"sc": tables["sc"] + added}, rejects)


@pytest.mark.parametrize("seed", SEEDS)
def test_drop(spark, school, seed):
    tables = tables_of(school)
    changes = drawn(
        seed, 40, student_username=NAMES, course_id=[10, 20, None], semester=[SPRING, AUTUMN, LATER]
    )
    students = accounts(tables, "student")
    taken = {(r["student_id"], r["course_id"], r["semester"]) for r in tables["sc"]}
    key = lambda c: (students.get(low(c["student_username"])), c["course_id"], c["semester"])

    def reason(c):
        if low(c["student_username"]) not in students:
            return "unknown_user"
        return None if key(c) in taken else "no_such_row"

    won, rejects = walk(changes, reason, key)
    sc = [r for r in tables["sc"] if (r["student_id"], r["course_id"], r["semester"]) not in won]
    schema = "change_seq BIGINT, student_username STRING, course_id BIGINT, semester STRING"
    check(op.drop(school, frame(spark, schema, changes)), tables, {"sc": sc}, rejects)


@pytest.mark.parametrize("seed", SEEDS)
def test_upsert_courses(spark, school, seed):
    tables = tables_of(school)
    changes = drawn(
        seed, 60, course_id=[10, 20, 40, 50, None], name=["New", "Other", "", None],
        description=["", "words", None], credits=["1", "10", "11", "0", "x", None],
    )

    def reason(c):
        points = number(c["credits"])
        if c["course_id"] is None or not c["name"] or points is None or not 1 <= points <= 10:
            return "invalid_value"
        return None

    won, rejects = walk(changes, reason, lambda c: c["course_id"], last=True)
    course = [r for r in tables["course"] if r["course_id"] not in won] + [
        {"course_id": k, "name": c["name"], "description": c["description"] or None, "credits": int(c["credits"])}
        for k, c in won.items()
    ]
    schema = "change_seq BIGINT, course_id BIGINT, name STRING, description STRING, credits STRING"
    batch = frame(spark, schema, changes)
    outcome = op.upsert_courses(school, batch)
    check(outcome, tables, {"course": course}, rejects)
    same(plain(op.upsert_courses(outcome.school, batch).school.course), course)


@pytest.mark.parametrize("seed", SEEDS)
def test_add_sections(spark, school, seed):
    tables = tables_of(school)
    changes = drawn(
        seed, 80, teacher_id=[2, 4, 6, 1, None], course_id=[10, 20, 99], semester=[SPRING, LATER, "", None]
    )
    teachers = {r["teacher_id"] for r in tables["teacher"]}
    courses = {r["course_id"] for r in tables["course"]}
    key = lambda c: (c["teacher_id"], c["course_id"], c["semester"])
    sections = {key(r) for r in tables["tc"]}

    def reason(c):
        if not c["semester"]:
            return "invalid_value"
        if c["teacher_id"] not in teachers or c["course_id"] not in courses:
            return "no_such_row"
        return "duplicate" if key(c) in sections else None

    won, rejects = walk(changes, reason, key)
    tc = tables["tc"] + [dict(zip(("teacher_id", "course_id", "semester"), k)) for k in won]
    schema = "change_seq BIGINT, teacher_id BIGINT, course_id BIGINT, semester STRING"
    check(op.add_sections(school, frame(spark, schema, changes)), tables, {"tc": tc}, rejects)


@pytest.mark.parametrize(
    ("operator", "owners", "choices", "columns"),
    [
        (op.delete_courses, ("course", "tc", "sc"), {"course_id": [10, 30, 99, None]}, ("course_id",)),
        (
            op.delete_sections,
            ("tc", "sc"),
            {"teacher_id": [2, 4, None], "course_id": [10, 20], "semester": [SPRING, LATER]},
            ("teacher_id", "course_id", "semester"),
        ),
    ],
)
def test_delete_courses_and_sections(spark, school, operator, owners, choices, columns):
    tables = tables_of(school)
    changes = drawn(3, 12, **choices)
    key = lambda r: tuple(r[c] for c in columns)
    known = {key(r) for r in tables[owners[0]]}
    won, rejects = walk(changes, lambda c: None if key(c) in known else "no_such_row", key)
    kept = {t: [r for r in tables[t] if key(r) not in won] for t in owners}
    gone = [long_form(t, r) for t in owners for r in tables[t] if key(r) in won]
    types = {"semester": "STRING"}
    schema = ", ".join(["change_seq BIGINT", *(f"{c} {types.get(c, 'BIGINT')}" for c in columns)])
    assert gone
    check(operator(school, frame(spark, schema, changes)), tables, kept, rejects, gone)


def test_delete_users(spark, school):
    tables = tables_of(school)
    changes = drawn(4, 12, username=["ANN", "ann", "tom", "nobody", None])
    known = {u["username"].lower(): u["user_id"] for u in tables["users"]}
    key = lambda c: low(c["username"])
    won, rejects = walk(changes, lambda c: None if key(c) in known else "unknown_user", key)
    ids = {known[name] for name in won}
    lost = lambda r: any(r.get(c) in ids for c in ("user_id", "student_id", "teacher_id"))
    owners = ("users", "student", "teacher", "tc", "sc")
    kept = {t: [r for r in tables[t] if not lost(r)] for t in owners}
    gone = [long_form(t, r) for t in owners for r in tables[t] if lost(r)]
    outcome = op.delete_users(school, frame(spark, "change_seq BIGINT, username STRING", changes))
    check(outcome, tables, kept, rejects, gone)


@pytest.mark.parametrize("seed", SEEDS)
def test_add_users(spark, school, seed):
    tables = tables_of(school)
    changes = drawn(
        seed, 150, user_id=[1, 11, 12, 13, 14, 15, 16, None], username=["Ann", "Dan", "DAN", "Eve", "Fay", "Gus", ""],
        role=["student", "Teacher", "ADMIN", "dean", None], name=["N"], gender=["男", "女", "", "x", None],
        birth_date=["2000-02-29", "", "soon", None], department=["", "Math"], introduction=["", "hi"],
    )
    ids = {u["user_id"] for u in tables["users"]}
    names = {u["username"].lower() for u in tables["users"]}

    def day(text):
        return date.fromisoformat(text) if text and text != "soon" else None

    def reason(c):
        if c["user_id"] is None or not c["username"] or low(c["role"]) not in ("student", "teacher", "admin"):
            return "invalid_value"
        if c["gender"] not in ("男", "女", "", None) or c["birth_date"] == "soon":
            return "invalid_value"
        return "duplicate" if c["user_id"] in ids or low(c["username"]) in names else None

    by_id, _ = walk(changes, reason, lambda c: c["user_id"])
    won, _ = walk(list(by_id.values()), lambda c: None, lambda c: low(c["username"]))
    accepted = list(won.values())
    unlike = [c for n, c in enumerate(changes) if c not in changes[:n]]  # twice is once
    rejects = [
        {**c, "reason": reason(c) or "superseded"} for c in unlike if reason(c) or c not in accepted
    ]
    people = {role: [c for c in accepted if low(c["role"]) == role] for role in ("student", "teacher")}
    expected = {
        "users": tables["users"]
        + [{"user_id": c["user_id"], "username": c["username"], "role": low(c["role"])} for c in accepted],
        "student": tables["student"]
        + [
            {"student_id": c["user_id"], "name": "N", "gender": c["gender"] or None, "birth_date": day(c["birth_date"])}
            for c in people["student"]
        ],
        "teacher": tables["teacher"]
        + [
            {
                "teacher_id": c["user_id"], "name": "N", "department": c["department"] or None,
                "introduction": c["introduction"] or None,
            }
            for c in people["teacher"]
        ],
    }
    schema = (
        "change_seq BIGINT, user_id BIGINT, username STRING, role STRING, name STRING, gender STRING, "
        "birth_date STRING, department STRING, introduction STRING"
    )
    assert accepted
    check(op.add_users(school, frame(spark, schema, changes)), tables, expected, rejects)


@pytest.mark.parametrize("seed", SEEDS)
def test_update_student_profiles(spark, school, seed):
    tables = tables_of(school)
    changes = drawn(
        seed, 60, student_username=NAMES, gender=["男", "女", "", "x", None], birth_date=["2000-01-02", "", "soon", None]
    )
    students = accounts(tables, "student")

    def reason(c):
        if c["gender"] == "x" or c["birth_date"] == "soon":
            return "invalid_value"
        return None if low(c["student_username"]) in students else "unknown_user"

    won, rejects = walk(changes, reason, lambda c: students.get(low(c["student_username"])), last=True)

    def updated(row):
        c = won.get(row["student_id"])
        if c is None:
            return row
        day = date.fromisoformat(c["birth_date"]) if c["birth_date"] else None
        return {**row, "gender": c["gender"] or None, "birth_date": day}

    schema = "change_seq BIGINT, student_username STRING, gender STRING, birth_date STRING"
    outcome = op.update_student_profiles(school, frame(spark, schema, changes))
    check(outcome, tables, {"student": [updated(r) for r in tables["student"]]}, rejects)


@pytest.mark.parametrize("seed", SEEDS)
def test_update_teacher_profiles(spark, school, seed):
    tables = tables_of(school)
    changes = drawn(
        seed, 50, teacher_username=NAMES, department=["Math", "", None], introduction=["", "text", None]
    )
    teachers = accounts(tables, "teacher")

    def reason(c):
        if not c["department"]:
            return "invalid_value"
        return None if low(c["teacher_username"]) in teachers else "unknown_user"

    won, rejects = walk(changes, reason, lambda c: teachers.get(low(c["teacher_username"])), last=True)

    def updated(row):
        c = won.get(row["teacher_id"])
        if c is None:
            return row
        return {**row, "department": c["department"], "introduction": c["introduction"] or None}

    schema = "change_seq BIGINT, teacher_username STRING, department STRING, introduction STRING"
    outcome = op.update_teacher_profiles(school, frame(spark, schema, changes))
    check(outcome, tables, {"teacher": [updated(r) for r in tables["teacher"]]}, rejects)


def test_a_profile_without_its_record_is_refused(spark):
    school = make_school(spark)
    bare = school.with_tables(student=school.student.filter("student_id <> 3"))
    schema = "change_seq BIGINT, student_username STRING, gender STRING, birth_date DATE"
    changes = spark.createDataFrame([(1, "bob", "男", date(2000, 1, 1))], schema)
    outcome = op.update_student_profiles(bare, changes)
    assert [r.reason for r in outcome.rejects.collect()] == ["no_such_row"]


def test_batches_chain(spark, school):
    """Each outcome's school is the input of the next batch."""
    enrolled = op.enrol(
        school,
        spark.createDataFrame(
            [(1, "cy", 2, 20, AUTUMN)],
            "change_seq BIGINT, student_username STRING, teacher_id BIGINT, course_id BIGINT, semester STRING",
        ),
    ).school
    graded = op.upsert_grades(
        enrolled,
        spark.createDataFrame(
            [(1, "tess", 5, 20, AUTUMN, 90)],
            "change_seq BIGINT, teacher_username STRING, student_id BIGINT, course_id BIGINT, semester STRING, score INT",
        ),
    ).school
    status = {r.semester: r for r in op.grade_status(graded, 2).filter("course_id = 20").collect()}
    assert (status[AUTUMN].enrolled, status[AUTUMN].graded) == (1, 1)
