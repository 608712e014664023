"""School tables seen in an order-processing data set.

customer -> student, supplier -> teacher, nation -> administrator, part -> course,
order lines -> enrolments. Every row of every table takes part. Odd corners come from mapping
rows, not from leaving any out: orders of one customer in fifty count for another
one, which leaves students without an enrolment, and lines of five neighbouring
parts count for the first, which leaves courses that were never offered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.school import School

# The columns used, declared so that no job has to look for them.
SOURCES = {
    "nation": "n_nationkey INT, n_name STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ",
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_returnflag STRING, l_linestatus STRING"
    ),
}

EMPTY_SEMESTER = "2003春"

# Keys of students are even, of teachers odd, of administrators far below zero: all
# of them are keys of users as well.
STUDENT_KEY = "c_custkey * 2 + 2"
TEACHER_KEY = "s_suppkey * 2 + 1"
ADMIN_KEY = "-4000000000000 - n_nationkey"


def semester_no(semester: str) -> str:
    """Semesters numbered in order of time (SQL text)."""
    return f"(int(substring({semester}, 1, 4)) * 2 + int(endswith({semester}, '秋')))"


class Projection:
    """Lazy school tables over the parquet files in ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root

    def source(self, name: str) -> DataFrame:
        return self.spark.read.schema(SOURCES[name]).parquet(f"{self.root}/{name}.parquet")

    def student(self) -> DataFrame:
        return self.source("customer").selectExpr(
            f"{STUDENT_KEY} AS student_id",
            "c_name AS name",
            "CASE WHEN c_custkey % 10 = 9 THEN NULL WHEN c_custkey % 2 = 0 THEN '男' ELSE '女' END AS gender",
            "CASE WHEN c_custkey % 7 <> 6"
            " THEN make_date(int(2000 + c_custkey % 6), int(1 + c_custkey % 9), 15) END AS birth_date",
        )

    def teacher(self) -> DataFrame:
        nation = self.source("nation").withColumnRenamed("n_nationkey", "s_nationkey")
        return (
            self.source("supplier")
            .join(nation, "s_nationkey")
            .selectExpr(
                f"{TEACHER_KEY} AS teacher_id",
                "s_name AS name",
                "n_name AS department",
                "CASE WHEN s_suppkey % 3 <> 0 THEN concat('bio ', s_name) END AS introduction",
            )
        )

    def course(self) -> DataFrame:
        return self.source("part").selectExpr(
            "p_partkey AS course_id",
            "p_name AS name",
            "concat(p_type, ' ', p_brand) AS description",
            "1 + p_size % 10 AS credits",
        )

    def users(self) -> DataFrame:
        def accounts(table: str, key: str, role: str) -> DataFrame:
            return self.source(table).selectExpr(
                f"{key} AS user_id", f"concat('{role}', {key}) AS username", f"'{role}' AS role"
            )

        return (
            accounts("customer", STUDENT_KEY, "student")
            .union(accounts("supplier", TEACHER_KEY, "teacher"))
            .union(accounts("nation", ADMIN_KEY, "admin"))
        )

    def _assigned(self, rows: DataFrame, group: str) -> DataFrame:
        """Add the teacher of a student group in a course and semester.

        Computed from the keys, so that no window or join over the enrolments is
        needed. Suppliers in the red leave the last few teachers without work.
        """
        active = self.source("supplier").filter("s_acctbal >= 0").agg(F.count("*")).scalar()
        return rows.withColumn("active", active).withColumn(
            "teacher_id", F.expr(f"(course_id * 31 + term * 7 + {group} * 3) % active * 2 + 1")
        )

    def sc(self) -> DataFrame:
        """Enrolments, aggregated over whole numbers; the semester is spelled out last."""
        orders = self.source("orders").selectExpr(
            "o_orderkey AS l_orderkey",
            "CASE WHEN o_custkey % 50 = 49 THEN o_custkey - 49 ELSE o_custkey END * 2 + 2 AS student_id",
            "year(o_orderdate) * 2 + int(month(o_orderdate) > 6) AS term",
        )
        lines = self.source("lineitem").selectExpr(
            "l_orderkey",
            "l_partkey - l_partkey % 5 AS course_id",
            "CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL"
            " ELSE int(2 * l_quantity) - l_linenumber % 2 END AS score",
        )
        taken = (
            lines.join(orders, "l_orderkey")
            .groupBy("student_id", "course_id", "term")
            .agg(F.max("score").alias("score"))
        )
        return self._assigned(taken, "student_id % 4").selectExpr(
            "student_id",
            "course_id",
            "concat(term div 2, CASE WHEN term % 2 = 0 THEN '春' ELSE '秋' END) AS semester",
            "teacher_id",
            "score",
        )

    def in_empty_semester(self, rows: DataFrame) -> DataFrame:
        """Move rows with a course to the semester in which nobody is enrolled yet."""
        moved = rows.selectExpr("*", f"{semester_no(repr(EMPTY_SEMESTER))} AS term")
        return self._assigned(moved, "0").withColumn("semester", F.lit(EMPTY_SEMESTER))

    def tc(self, sc: DataFrame) -> DataFrame:
        section = ["teacher_id", "course_id", "semester"]
        empty = self.in_empty_semester(self.course().filter("credits > 5"))
        return sc.select(*section).distinct().union(empty.select(*section))

    def school(self, sc: DataFrame | None = None) -> School:
        """All six tables; ``sc`` may be given in a staged form."""
        enrolments = self.sc() if sc is None else sc
        return School(
            users=self.users(),
            student=self.student(),
            teacher=self.teacher(),
            course=self.course(),
            tc=self.tc(enrolments),
            sc=enrolments,
        )
