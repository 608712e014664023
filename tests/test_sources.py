from __future__ import annotations

import os

import pytest
from conftest import SMALL, make_school, rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from rollbook import operators as op
from rollbook.school import TABLES, schemas
from rollbook.sources import read_jdbc, read_school, write_snapshot
from rollbook.sources.projection import Projection
from rollbook.sources.staging import forget, stage


def test_snapshot_round_trip(spark, school, tmp_path):
    root = str(tmp_path / "v1")
    write_snapshot(school, root)
    stored = read_school(spark, root)
    for name in TABLES:
        assert [f.dataType for f in getattr(stored, name).schema] == [
            f.dataType for f in schemas()[name]
        ]
        assert rows(getattr(stored, name)) == rows(getattr(school, name))
    assert {d for d in os.listdir(f"{root}/sc") if "=" in d} == {"semester=2024春", "semester=2024秋"}


def test_a_new_snapshot_never_overwrites_the_old_one(spark, school, tmp_path):
    old, new = str(tmp_path / "v1"), str(tmp_path / "v2")
    write_snapshot(school, old)
    stored = read_school(spark, old)
    key = "change_seq BIGINT, teacher_id BIGINT, course_id BIGINT, semester STRING"
    changes = spark.createDataFrame([(1, 2, 10, "2024春")], key)
    outcome = op.delete_sections(stored, changes)
    with pytest.raises(AnalysisException):
        write_snapshot(outcome.school, old)
    write_snapshot(outcome.school, new)
    assert read_school(spark, old).sc.count() == 5
    assert read_school(spark, new).sc.count() == 3


def test_a_hot_semester_is_written_by_several_tasks(spark, school, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256KB")
    try:
        sc = spark.range(400_000, numPartitions=8).selectExpr(
            "id AS student_id", "id AS course_id", "IF(id % 3 = 0, '2024春', '2024秋') AS semester",
            "id AS teacher_id", "INT(id % 101) AS score",
        )
        write_snapshot(school.with_tables(sc=sc), str(tmp_path / "v1"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    for semester in ("2024春", "2024秋"):
        files = os.listdir(tmp_path / "v1" / "sc" / f"semester={semester}")
        assert len([f for f in files if f.endswith(".parquet")]) > 1


def grade(spark, score: int):
    key = "change_seq BIGINT, teacher_username STRING, student_id BIGINT, course_id BIGINT"
    row = (1, "tess", 3, 10, "2024春", score)
    return spark.createDataFrame([row], f"{key}, semester STRING, score INT")


def test_a_small_change_writes_its_semester_only(spark, school, tmp_path):
    old, new = str(tmp_path / "v1"), str(tmp_path / "v2")
    write_snapshot(school, old)
    outcome = op.upsert_grades(read_school(spark, old), grade(spark, 77))
    write_snapshot(outcome.school, new, ("sc",), old, outcome.semesters)
    assert {d for d in os.listdir(new) if not d.startswith(".")} == {"sc", "manifest"}
    assert {d for d in os.listdir(f"{new}/sc") if "=" in d} == {"semester=2024春"}
    stored = read_school(spark, new)
    for name in TABLES:
        expected = outcome.school.sc if name == "sc" else getattr(school, name)
        assert rows(getattr(stored, name)) == rows(expected)
    # and once more, on top of a snapshot that is itself in two places
    third = op.upsert_grades(stored, grade(spark, 78))
    write_snapshot(third.school, str(tmp_path / "v3"), ("sc",), new, third.semesters)
    assert rows(read_school(spark, str(tmp_path / "v3")).sc) == rows(third.school.sc)
    assert read_school(spark, old).sc.filter("score = 77 OR score = 78").isEmpty()


def test_an_incomplete_snapshot_is_refused(spark, school, tmp_path):
    root = str(tmp_path / "v1")
    write_snapshot(school, root)
    for file in os.listdir(f"{root}/manifest"):
        os.remove(f"{root}/manifest/{file}")
    os.rmdir(f"{root}/manifest")
    with pytest.raises(ValueError):
        read_school(spark, root)
    with pytest.raises(ValueError):
        write_snapshot(school, str(tmp_path / "v2"), ("sc",))


def test_text_ids_can_be_read(spark, tmp_path):
    from pyspark.sql import types as T

    school = make_school(spark, T.StringType(), lambda n: f"id{n}")
    write_snapshot(school, str(tmp_path / "v1"))
    stored = read_school(spark, str(tmp_path / "v1"), T.StringType())
    assert rows(stored.sc) == rows(school.sc)


def test_split_column_needs_bounds(spark):
    with pytest.raises(ValueError):
        read_jdbc(spark, "jdbc:none", "sc", split_column="student_id")


def test_a_read_in_one_task_has_to_be_asked_for(spark):
    for choice in ({}, {"predicates": []}, {"predicates": ["a"], "in_one_task": True}):
        with pytest.raises(ValueError):
            read_jdbc(spark, "jdbc:none", "sc", **choice)


@pytest.fixture(scope="module")
def projected(spark):
    return Projection(spark, SMALL).school()


def test_keys_are_unique(projected):
    for name, key in {
        "users": ["user_id"],
        "student": ["student_id"],
        "teacher": ["teacher_id"],
        "course": ["course_id"],
        "tc": ["teacher_id", "course_id", "semester"],
        "sc": ["student_id", "course_id", "semester"],
    }.items():
        table = getattr(projected, name)
        assert table.count() == table.select(*key).distinct().count()
    assert projected.users.select(F.lower("username")).distinct().count() == projected.users.count()


def test_no_dangling_references(projected):
    sc, tc = projected.sc, projected.tc
    for table, key in (
        (projected.student, ["student_id"]),
        (projected.course, ["course_id"]),
        (projected.teacher, ["teacher_id"]),
        (tc, ["teacher_id", "course_id", "semester"]),
    ):
        assert sc.join(table, key, "left_anti").isEmpty()


def test_edge_cases_are_present(projected):
    sc, tc = projected.sc, projected.tc
    assert not projected.student.join(sc, "student_id", "left_anti").isEmpty()
    assert not projected.course.join(tc, "course_id", "left_anti").isEmpty()
    assert not tc.join(sc, ["teacher_id", "course_id", "semester"], "left_anti").isEmpty()
    assert not sc.groupBy("student_id", "course_id").count().filter("count > 1").isEmpty()
    for condition in ("score IS NULL", "score = 60", "score = 59"):
        assert not sc.filter(condition).isEmpty()


def test_figures_add_up(projected):
    credits = op.credit_summary(projected)
    ungraded = F.col("total_courses") - F.col("passed_courses") - F.col("failed_courses")
    assert credits.filter(ungraded < 0).isEmpty()
    status = op.grade_status(projected)
    assert status.filter("enrolled <> graded + pending").isEmpty()
    enrolled = op.course_statistics(projected).agg(F.sum("enrolled")).first()[0]
    assert enrolled == projected.sc.count() == status.agg(F.sum("enrolled")).first()[0]


def test_a_staged_table_is_dropped_alone(spark):
    kept, gone = stage(spark.range(5), "kept"), stage(spark.range(3), "gone")
    name = gone.inputFiles()[0].split("/")[-2]
    forget(gone)
    assert kept.count() == 5
    assert not any(spark.catalog.tableExists(f"{d.name}.{name}") for d in spark.catalog.listDatabases())
    forget(stage(spark.range(0), "empty"))
