"""Shape of the plans: what reaches the scan, what is shuffled, what is split."""

from __future__ import annotations

import os
import re

import pytest

from rollbook import operators as op
from rollbook.operators.changes import _as_delivered, _resolved
from rollbook.school import School
from rollbook.sources import read_school, stage, write_snapshot
from rollbook.sources.staging import rows_width, shared_folder


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    """The plan adaptive execution ended with."""
    execution = df._jdf.queryExecution()
    execution.toRdd().count()
    return execution.executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, school, tmp_path_factory) -> School:
    root = str(tmp_path_factory.mktemp("plans") / "v1")
    write_snapshot(school, root)
    return read_school(spark, root)


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    before = {}

    def change(**options):
        for name, value in options.items():
            key = "spark.sql." + name.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.fixture
def no_broadcast(conf):
    conf(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")


def test_scan_reads_needed_columns_only(stored):
    text = plan(op.credit_summary(stored))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert sorted(schemas) == [
        "course_id:bigint,credits:int",
        "student_id:bigint",
        "student_id:bigint,course_id:bigint,score:int",
    ]


def test_filters_reach_the_scan(stored):
    assert "EqualTo(student_id,1)" in plan(op.grades_all(stored, student_id=1))
    assert "GreaterThanOrEqual(credits,0)" in plan(op.course_search(stored, min_credits=0))
    # a filter on the course dimension is carried over to the enrolments
    assert plan(op.grades_by_course(stored, 10)).count("EqualTo(course_id,10)") == 2


def test_semester_prunes_partitions(stored):
    for df in (
        op.grades_by_semester(stored, "2024春"),
        op.course_statistics(stored, semester="2024春"),
        op.grade_status(stored, semester="2024春"),
    ):
        sc = [line for line in plan(df).splitlines() if "/sc]" in line]
        assert sc and all(re.search(r"PartitionFilters: \[[^\]]*= 2024春", line) for line in sc)


def test_facts_are_aggregated_before_they_are_shuffled(stored, no_broadcast):
    """In every statistic the enrolments meet a partial aggregate below the first exchange."""
    for operator in (
        op.credit_summary,
        op.student_overview,
        op.course_statistics,
        op.semester_statistics,
        op.teacher_statistics,
        op.student_statistics,
        op.grade_status,
        op.course_detail,
    ):
        lines = plan(operator(stored)).splitlines()
        for at, line in enumerate(lines):
            if "/sc]" in line:
                above = [x for x in reversed(lines[:at]) if "Exchange" in x or "Aggregate" in x]
                assert "HashAggregate" in above[0], operator.__name__


def test_distinct_counts_spread_a_hot_group(stored, no_broadcast):
    """Distinct students are shuffled by group and student, not by the group alone."""
    text = plan(op.semester_statistics(stored))
    assert re.search(r"Exchange hashpartitioning\(semester#\d+, student_id#\d+L", text)


def test_small_dimensions_are_broadcast_by_size(stored, conf):
    assert "BroadcastHashJoin" in plan(op.grades_all(stored))
    conf(autoBroadcastJoinThreshold="1")
    assert "BroadcastHashJoin" not in plan(op.grades_all(stored))


def test_upsert_reads_the_enrolments_once(spark, stored, no_broadcast):
    schema = (
        "change_seq BIGINT, teacher_username STRING, student_id BIGINT, course_id BIGINT, "
        "semester STRING, score INT"
    )
    changes = spark.createDataFrame([(1, "tess", 3, 10, "2024春", 50)], schema)
    text = plan(op.upsert_grades(stored, changes).school.sc)
    assert text.count("/sc]") == 1
    # one change per key is chosen on both sides of the exchange
    assert text.count("SortAggregate") == 2


def above_scan(text: str, table: str) -> list[str]:
    """The operators over each scan of a table, nearest first, up to the first join."""
    lines, found = text.splitlines(), []
    for at, line in enumerate(lines):
        if f"/{table}]" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            chain = []
            for upper in reversed(lines[:at]):
                indent = len(upper) - len(upper.lstrip(" :+-"))
                if indent < depth:
                    depth = indent
                    chain.append(upper.lstrip(" :+-*()0123456789").split(" ")[0])
                    if "Join" in chain[-1]:
                        break
            found.append(chain)
    return found


@pytest.mark.parametrize("name", ["sc", "rejects"])
def test_a_small_batch_does_not_shuffle_the_enrolments(spark, stored, conf, name):
    """The enrolments meet a broadcast join before anything else.

    The threshold is near the size of a batch: estimates of joins lie far above it.
    """
    conf(autoBroadcastJoinThreshold="12KB")
    account = "change_seq BIGINT, {0}_username STRING, student_id BIGINT, teacher_id BIGINT"
    rest = ", course_id BIGINT, semester STRING, score INT"
    teachers, students = (
        stage(
            spark.createDataFrame([(1, who, 3, 2, 10, "2024春", 50)], account.format(role) + rest),
            "batch",
        )
        for role, who in (("teacher", "tess"), ("student", "bob"))
    )
    for operator, changes in (
        (op.upsert_grades, teachers.drop("teacher_id")),
        (op.delete_grades, teachers.drop("teacher_username", "score")),
        (op.drop, students.drop("student_id", "teacher_id", "score")),
        (op.enrol, students.drop("student_id", "score")),
    ):
        outcome = operator(stored, changes)
        df = outcome.rejects if name == "rejects" else outcome.school.sc
        chains = [c for c in above_scan(plan(df), "sc") if "Union" not in c]
        # rejects, and new enrolments, look up keys narrowed to the batch's before
        assert bool(chains) == (name == "sc" and operator is not op.enrol)
        for chain in chains:
            assert chain[-1] == "BroadcastHashJoin" and "Exchange" not in chain, operator.__name__


def test_totals_read_the_enrolments_once(stored):
    text = final_plan(op.system_statistics(stored))
    assert len(re.findall(r"ReusedSubquery", text)) >= 2 or text.count("/sc]") == 1


# ------------------------------------------------------------------ skew


@pytest.fixture(scope="module")
def skewed(spark, school, tmp_path_factory) -> School:
    """Half of 300,000 enrolments in one course, with one teacher."""
    root = str(tmp_path_factory.mktemp("skew"))
    keys = spark.range(300_000, numPartitions=8)
    sc = keys.selectExpr(
        "id AS student_id",
        "IF(id % 2 = 0, 7, id % 5000) AS course_id",
        "'2024春' AS semester",
        "IF(id % 2 = 0, 3, id % 900) AS teacher_id",
        "INT(id % 101) AS score",
    )
    course = spark.range(5000).selectExpr(
        "id AS course_id", "concat('c', id) AS name", "'' AS description", "INT(1 + id % 10) AS credits"
    )
    teacher = spark.range(900).selectExpr(
        "id AS teacher_id", "concat('t', id) AS name", "'d' AS department", "'' AS introduction"
    )
    users = teacher.selectExpr("teacher_id AS user_id", "name AS username", "'teacher' AS role")
    tables = {
        "sc": sc,
        "course": course,
        "teacher": teacher,
        "users": users,
        "tc": sc.select("teacher_id", "course_id", "semester"),
        "student": keys.selectExpr(
            "id AS student_id", "concat('s', id) AS name", "string(NULL) AS gender", "date(NULL) AS birth_date"
        ),
    }
    for name, frame in tables.items():
        frame.write.parquet(f"{root}/{name}")
    return School(**{name: spark.read.parquet(f"{root}/{name}") for name in tables})


@pytest.fixture
def split_early(conf, no_broadcast):
    """Adaptive execution takes small partitions for skewed ones."""
    conf(
        shuffle__partitions="8",
        adaptive__coalescePartitions__enabled="false",
        adaptive__skewJoin__skewedPartitionFactor="1.5",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="1KB",
        adaptive__advisoryPartitionSizeInBytes="64KB",
    )


@pytest.mark.parametrize(
    "operator",
    [op.grades_all, op.student_courses, op.teacher_sections, op.teacher_grades, op.course_search],
    ids=lambda f: f.__name__,
)
def test_joins_split_a_hot_course(skewed, split_early, operator):
    assert "skew=true" in final_plan(operator(skewed))


def test_lookups_split_a_hot_account_and_a_hot_enrolment(spark, skewed, split_early):
    """Half of the changes come from one teacher and touch one enrolment."""
    changes = skewed.sc.selectExpr(
        "student_id AS change_seq",
        "IF(student_id % 2 = 0, 'T3', concat('t', teacher_id)) AS teacher_username",
        "IF(student_id % 2 = 0, 0, student_id) AS student_id",
        "course_id",
        "semester",
        "string(score) AS score",
    )
    named = _resolved(changes, skewed, "teacher_username", "teacher", "teacher_id")
    assert "skew=true" in final_plan(named)
    rejects = op.upsert_grades(skewed, changes).rejects
    assert "skew=true" in final_plan(rejects)
    hot = rejects.filter("student_id = 0").groupBy("reason").count().collect()
    assert [(r.reason, r["count"]) for r in hot] == [("superseded", 149_999)]


def test_staging_needs_the_shared_folder():
    class Unset:
        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Unset)


def test_a_regular_batch_is_as_large_as_its_rows(spark, conf):
    """Two million changes coded well would fit the threshold; in memory they do not."""
    conf(autoBroadcastJoinThreshold="10MB")
    other = spark.range(3_000_000).withColumnRenamed("id", "key")
    regular = ["id div 1000 AS key", "id % 1000 AS part", "'2024春' AS semester"]
    for rows, broadcast in ((2_000_000, False), (10, True)):
        batch = stage(spark.range(rows).selectExpr(*regular), "changes", plain=True)
        joined = other.join(batch.select("key", "part", "semester"), "key")
        assert ("BroadcastHashJoin" in plan(joined)) == broadcast


def test_like_texts_are_as_large_as_their_rows(spark, conf):
    """95 MB of texts of one shape compress to some kilobytes; ten rows of them are small."""
    conf(autoBroadcastJoinThreshold="10MB")
    other = spark.range(3_000_000).withColumnRenamed("id", "key")
    for rows, broadcast in ((40_000, False), (10, True)):
        tree = spark.range(rows).selectExpr("id AS key", "repeat('<div><p class=a>', 149) AS tree")
        kept = stage(tree, "trees", sized=True)
        assert kept.count() == rows
        assert ("BroadcastHashJoin" in plan(other.join(kept, "key"))) == broadcast


def test_width_of_nested_rows(spark):
    rows = spark.sql(
        "SELECT 1L AS a, 'xyz' AS b, array(1, 2, 3) AS c, array('ab', 'c', NULL) AS d, "
        "named_struct('e', 'text', 'f', 2) AS g, map('k', 'v') AS h, CAST(NULL AS STRING) AS i, array(array(1)) AS j"
    )
    assert 100 < rows_width(rows) < 300
    assert rows_width(rows.union(rows)) == 2 * rows_width(rows)
    assert rows_width(rows.limit(0)) == 0


@pytest.mark.parametrize(
    "operator, columns",
    [
        (op.delete_courses, "course_id"),
        (op.delete_sections, "teacher_id, course_id, semester"),
        (op.delete_grades, "teacher_id, student_id, course_id, semester"),
    ],
    ids=lambda x: getattr(x, "__name__", ""),
)
def test_rejects_without_payload_need_no_sort_and_no_keys_gone(spark, stored, operator, columns):
    changes = stored.sc.selectExpr("1L AS change_seq", *columns.split(", "))
    outcome = operator(stored, changes)
    database = "rollbook_" + spark.conf.get("spark.app.id").replace("-", "_").lower()
    gone = f"SHOW TABLES IN {database} LIKE 'gone*'"
    before = spark.sql(gone).count()
    assert "SortAggregate" not in plan(outcome.rejects)
    assert spark.sql(gone).count() == before
    outcome.school  # noqa: B018
    assert spark.sql(gone).count() == before + (operator is not op.delete_grades)


def test_staged_tables_go_to_the_shared_folder(spark):
    staged = stage(spark.range(5).selectExpr("id", "id * 2 AS twice"), "numbers")
    shared = spark.conf.get("spark.checkpoint.dir")
    assert all(file.startswith(f"file://{shared}/") for file in staged.inputFiles())
    assert sorted(map(tuple, staged.collect())) == [(n, 2 * n) for n in range(5)]


def test_keys_with_two_changes_are_settled_without_the_batch(spark, stored, no_broadcast):
    """A large batch meets the tables once; only keys with more changes are looked up again."""
    batch = stored.sc.selectExpr(
        "explode(array(1L, 2L)) AS change_seq",
        "IF(student_id = 1, 'ann', 'bob') AS student_username",
        "'tess' AS teacher_username",
        "student_id",
        "teacher_id",
        "course_id",
        "semester",
        "51 AS score",
    )
    for operator, left_out in (
        (op.enrol, ["teacher_username", "student_id", "score"]),
        (op.drop, ["teacher_username", "student_id", "teacher_id", "score"]),
        (op.upsert_grades, ["student_username", "teacher_id"]),
        (op.delete_grades, ["student_username", "teacher_username", "score"]),
    ):
        changes = batch.drop(*left_out)
        rejects = operator(stored, changes).rejects
        assert "Join" not in plan(rejects), operator.__name__
        third = operator(stored, changes.union(changes.withColumn("change_seq", changes.change_seq + 2)))
        assert "Join" in plan(third.rejects), operator.__name__
        assert third.rejects.count() == third.rejects.distinct().count()
        assert not third.rejects.isEmpty()


def test_changes_to_an_account_name_of_two_ids_are_refused_once(spark, school):
    schema = "change_seq BIGINT, student_username STRING, course_id BIGINT, semester STRING"
    twins = school.users.union(spark.createDataFrame([(5_000, "BOB", "student")], school.users.schema))
    changes = spark.createDataFrame([(1, "bob", 10, "1999春"), (2, "bob", 10, "1999春")], schema)
    rejects = op.drop(school.with_tables(users=twins), changes).rejects
    assert sorted((r.change_seq, r.reason) for r in rejects.collect()) == [
        (1, "no_such_row"), (2, "no_such_row")
    ]


def test_changes_to_enrolments_are_staged_compressed(skewed):
    changes = skewed.sc.selectExpr("1L AS change_seq", "teacher_id", "student_id", "course_id", "semester")

    def size(staged) -> int:
        return sum(os.path.getsize(file.removeprefix("file://")) for file in staged.inputFiles())

    plainly = stage(changes, "changes", plain=True)
    assert size(_as_delivered(changes)) < size(plainly) / 2
    assert size(_as_delivered(changes, light=False)) < size(plainly) / 2
