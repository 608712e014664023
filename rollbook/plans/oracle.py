"""The registered queries in plain SQL, for an independent engine.

Written from the meaning of each operator, not from its Spark plan: windows and
EXISTS where the operators use aggregates and joins.
"""

from __future__ import annotations

_SCHOOL = """
student AS (
  SELECT c_custkey * 2 + 2 AS student_id, c_name AS name,
    CASE WHEN c_custkey % 10 = 9 THEN NULL WHEN c_custkey % 2 = 0 THEN '男' ELSE '女' END AS gender,
    CASE WHEN c_custkey % 7 = 6 THEN NULL ELSE
      CAST(CONCAT(CAST(2000 + c_custkey % 6 AS STRING), '-0', CAST(1 + c_custkey % 9 AS STRING), '-15') AS DATE)
    END AS birth_date
  FROM customer),
teacher AS (
  SELECT s_suppkey * 2 + 1 AS teacher_id, s_name AS name, n_name AS department,
    CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE CONCAT('bio ', s_name) END AS introduction
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
course AS (
  SELECT p_partkey AS course_id, p_name AS name, CONCAT(p_type, ' ', p_brand) AS description,
    1 + p_size % 10 AS credits
  FROM part),
users AS (
  SELECT c_custkey * 2 + 2 AS user_id, CONCAT('student', CAST(c_custkey * 2 + 2 AS STRING)) AS username, 'student' AS role FROM customer
  UNION ALL
  SELECT s_suppkey * 2 + 1, CONCAT('teacher', CAST(s_suppkey * 2 + 1 AS STRING)), 'teacher' FROM supplier
  UNION ALL
  SELECT -4000000000000 - n_nationkey, CONCAT('admin', CAST(-4000000000000 - n_nationkey AS STRING)), 'admin' FROM nation),
active AS (SELECT COUNT(*) AS n FROM supplier WHERE s_acctbal >= 0),
raw_sc AS (
  SELECT (CASE WHEN o_custkey % 50 = 49 THEN o_custkey - 49 ELSE o_custkey END) * 2 + 2 AS student_id,
    l_partkey - l_partkey % 5 AS course_id,
    CONCAT(CAST(year(o_orderdate) AS STRING), CASE WHEN month(o_orderdate) <= 6 THEN '春' ELSE '秋' END) AS semester,
    CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN NULL
         ELSE CAST(2 * l_quantity AS INT) - l_linenumber % 2 END AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sc AS (
  SELECT student_id, course_id, semester,
    ((course_id * 31
      + (CAST(SUBSTRING(semester, 1, 4) AS INT) * 2 + CASE WHEN semester LIKE '%秋' THEN 1 ELSE 0 END) * 7
      + (student_id % 4) * 3) % (SELECT n FROM active)) * 2 + 1 AS teacher_id,
    MAX(score) AS score
  FROM raw_sc GROUP BY student_id, course_id, semester),
tc AS (
  SELECT DISTINCT teacher_id, course_id, semester FROM sc
  UNION ALL
  SELECT ((course_id * 31 + 4006 * 7) % (SELECT n FROM active)) * 2 + 1, course_id, '2003春'
  FROM course WHERE credits > 5),
grades AS (
  SELECT sc.student_id, sc.course_id, course.name AS course_name, course.credits,
    teacher.name AS teacher_name, sc.semester, sc.score, sc.teacher_id
  FROM sc, course, teacher
  WHERE sc.course_id = course.course_id AND sc.teacher_id = teacher.teacher_id)"""

_SEMESTER_NO = (
    "CAST(CAST(SUBSTRING(semester, 1, 4) AS INT) * 2"
    " + CASE WHEN semester LIKE '%秋' THEN 1 ELSE 0 END AS BIGINT)"
)


def _sql(body: str, *ctes: str) -> str:
    """One statement: the school tables, further CTEs, the body."""
    return "WITH " + ",\n".join([_SCHOOL.strip(), *ctes]) + "\n" + body


_GRADE_COLUMNS = "student_id, course_id, course_name, credits, teacher_name, semester, score"

_READS = {
    "find_users": """
SELECT user_id, username, role FROM users
WHERE LOWER(role) = 'student' AND LOWER(username) IN (SELECT LOWER(UPPER(username)) FROM users)""",
    "users_by_role": "SELECT username, role FROM users WHERE LOWER(role) = 'teacher'",
    "user_info": """
SELECT u.user_id, u.username, u.role, COALESCE(s.name, t.name) AS name, s.gender, s.birth_date,
  t.department, t.introduction
FROM users u LEFT JOIN student s ON s.student_id = u.user_id AND u.role = 'student'
LEFT JOIN teacher t ON t.teacher_id = u.user_id AND u.role = 'teacher'""",
    "grades_all": f"SELECT {_GRADE_COLUMNS} FROM grades",
    "grades_by_semester": f"SELECT {_GRADE_COLUMNS} FROM grades WHERE semester = '1998春'",
    "grades_by_course": f"SELECT {_GRADE_COLUMNS} FROM grades WHERE course_name LIKE '%widget%'",
    "grades_by_username": f"""
SELECT u.username, s.name AS student_name, g.* EXCLUDE (teacher_id)
FROM users u JOIN student s ON u.user_id = s.student_id JOIN grades g ON g.student_id = s.student_id
WHERE u.role = 'student'""",
    "teacher_grades": """
SELECT g.teacher_id, g.course_id, g.course_name, g.semester, g.student_id, s.name AS student_name, g.score
FROM grades g JOIN student s ON s.student_id = g.student_id""",
    "teacher_grades_semester": """
SELECT g.teacher_id, g.course_id, g.course_name, g.semester, g.student_id, s.name AS student_name, g.score
FROM grades g JOIN student s ON s.student_id = g.student_id WHERE g.semester = '1999秋'""",
    "student_courses": """
SELECT student_id, course_id, course_name, credits, teacher_id, teacher_name, semester FROM grades""",
    "teacher_sections": """
SELECT tc.teacher_id, tc.course_id, c.name AS course_name, c.credits, tc.semester
FROM tc JOIN course c ON c.course_id = tc.course_id""",
    "section_roster": """
SELECT sc.teacher_id, sc.course_id, sc.semester, sc.student_id, s.name AS student_name, s.gender
FROM sc JOIN student s ON s.student_id = sc.student_id""",
    "grade_status": """
SELECT tc.teacher_id, tc.course_id, tc.semester, COUNT(sc.student_id) AS enrolled,
  COUNT(sc.score) AS graded, COUNT(sc.student_id) - COUNT(sc.score) AS pending,
  COUNT(sc.student_id) > 0 AND COUNT(sc.student_id) = COUNT(sc.score) AS complete
FROM tc LEFT JOIN sc ON sc.teacher_id = tc.teacher_id AND sc.course_id = tc.course_id AND sc.semester = tc.semester
GROUP BY tc.teacher_id, tc.course_id, tc.semester""",
    "credit_summary": """
SELECT s.student_id, COUNT(b.course_id) AS total_courses,
  CAST(COALESCE(SUM(CASE WHEN b.best >= 60 THEN c.credits END), 0) AS BIGINT) AS earned_credits,
  CAST(COALESCE(SUM(c.credits), 0) AS BIGINT) AS total_attempted_credits,
  CAST(SUM(CASE WHEN b.best >= 60 THEN (b.best - 50) * c.credits ELSE 0 END) AS DOUBLE)
    / CAST(10 * SUM(CASE WHEN b.best IS NOT NULL THEN c.credits END) AS DOUBLE) AS overall_gpa,
  COUNT(CASE WHEN b.best >= 60 THEN 1 END) AS passed_courses,
  COUNT(CASE WHEN b.best < 60 THEN 1 END) AS failed_courses
FROM student s
LEFT JOIN (SELECT student_id, course_id, MAX(score) AS best FROM sc GROUP BY 1, 2) b ON b.student_id = s.student_id
LEFT JOIN course c ON c.course_id = b.course_id
GROUP BY s.student_id""",
    "credit_report": """
SELECT student_id, semester, COUNT(*) AS courses, CAST(SUM(credits) AS BIGINT) AS attempted_credits,
  CAST(SUM(CASE WHEN score >= 60 THEN credits ELSE 0 END) AS BIGINT) AS earned_credits,
  COUNT(CASE WHEN score >= 60 THEN 1 END) AS passed, COUNT(CASE WHEN score < 60 THEN 1 END) AS failed,
  CAST(SUM(CASE WHEN score >= 60 THEN (score - 50) * credits ELSE 0 END) AS DOUBLE)
    / CAST(10 * SUM(CASE WHEN score IS NOT NULL THEN credits END) AS DOUBLE) AS gpa
FROM grades GROUP BY student_id, semester""",
    "student_overview": """
SELECT s.student_id, s.name, s.gender, s.birth_date, COUNT(DISTINCT sc.semester) AS semesters,
  COUNT(DISTINCT sc.course_id) AS courses, COUNT(sc.score) AS graded, AVG(sc.score) AS avg_score,
  MAX(sc.semester) AS latest_semester
FROM student s LEFT JOIN sc ON sc.student_id = s.student_id
GROUP BY s.student_id, s.name, s.gender, s.birth_date""",
    "course_search": """
SELECT c.course_id, c.name, c.description, c.credits, tc.semester, tc.teacher_id, t.name AS teacher_name
FROM course c LEFT JOIN tc ON tc.course_id = c.course_id LEFT JOIN teacher t ON t.teacher_id = tc.teacher_id""",
    "course_search_filtered": """
SELECT c.course_id, c.name, c.description, c.credits, tc.semester, tc.teacher_id, t.name AS teacher_name
FROM course c LEFT JOIN tc ON tc.course_id = c.course_id LEFT JOIN teacher t ON t.teacher_id = tc.teacher_id
WHERE c.name ILIKE '%red%' AND t.name ILIKE '%supplier#%' AND c.credits BETWEEN 3 AND 8""",
    "course_search_blank": """
SELECT c.course_id, c.name, c.description, c.credits, tc.semester, tc.teacher_id, t.name AS teacher_name
FROM course c LEFT JOIN tc ON tc.course_id = c.course_id LEFT JOIN teacher t ON t.teacher_id = tc.teacher_id
WHERE c.credits <= 4""",
    "course_detail": """
SELECT c.course_id, c.name, c.description, c.credits, tc.semester, tc.teacher_id, t.name AS teacher_name,
  t.department, COUNT(sc.student_id) AS enrolled
FROM course c LEFT JOIN tc ON tc.course_id = c.course_id LEFT JOIN teacher t ON t.teacher_id = tc.teacher_id
LEFT JOIN sc ON sc.teacher_id = tc.teacher_id AND sc.course_id = tc.course_id AND sc.semester = tc.semester
GROUP BY c.course_id, c.name, c.description, c.credits, tc.semester, tc.teacher_id, t.name, t.department""",
    "system_statistics": """
SELECT (SELECT COUNT(*) FROM users) AS users,
  (SELECT COUNT(*) FROM users WHERE role = 'student') AS students,
  (SELECT COUNT(*) FROM users WHERE role = 'teacher') AS teachers,
  (SELECT COUNT(*) FROM users WHERE role = 'admin') AS admins,
  (SELECT COUNT(*) FROM course) AS courses, (SELECT COUNT(*) FROM tc) AS sections,
  (SELECT COUNT(*) FROM sc) AS enrolments, (SELECT COUNT(score) FROM sc) AS graded,
  (SELECT AVG(score) FROM sc) AS avg_score""",
    "course_statistics": """
SELECT o.course_id, c.name AS course_name, o.semester, o.sections, COUNT(sc.student_id) AS enrolled,
  COUNT(sc.score) AS graded, AVG(sc.score) AS avg_score, MAX(sc.score) AS max_score, MIN(sc.score) AS min_score,
  COUNT(CASE WHEN sc.score >= 60 THEN 1 END) AS passed, COUNT(CASE WHEN sc.score < 60 THEN 1 END) AS failed,
  CAST(COUNT(CASE WHEN sc.score >= 60 THEN 1 END) AS DOUBLE) / NULLIF(COUNT(sc.score), 0) AS pass_rate
FROM (SELECT course_id, semester, COUNT(*) AS sections FROM tc GROUP BY 1, 2) o
JOIN course c ON c.course_id = o.course_id
LEFT JOIN sc ON sc.course_id = o.course_id AND sc.semester = o.semester
GROUP BY o.course_id, c.name, o.semester, o.sections""",
    "semester_statistics": """
SELECT o.*, COALESCE(r.students, 0) AS students, COALESCE(r.enrolments, 0) AS enrolments,
  COALESCE(r.graded, 0) AS graded, r.avg_score, r.pass_rate
FROM (SELECT semester, COUNT(*) AS sections, COUNT(DISTINCT course_id) AS courses,
        COUNT(DISTINCT teacher_id) AS teachers FROM tc GROUP BY semester) o
LEFT JOIN (SELECT semester, COUNT(DISTINCT student_id) AS students, COUNT(*) AS enrolments,
        COUNT(score) AS graded, AVG(score) AS avg_score,
        CAST(COUNT(CASE WHEN score >= 60 THEN 1 END) AS DOUBLE) / NULLIF(COUNT(score), 0) AS pass_rate
      FROM sc GROUP BY semester) r ON r.semester = o.semester""",
    "teacher_statistics": """
SELECT t.teacher_id, t.name AS teacher_name, t.department, COALESCE(o.sections, 0) AS sections,
  COALESCE(o.courses, 0) AS courses, COALESCE(r.students, 0) AS students,
  COALESCE(r.enrolments, 0) AS enrolments, COALESCE(r.graded, 0) AS graded, r.avg_score, r.pass_rate
FROM teacher t
LEFT JOIN (SELECT teacher_id, COUNT(*) AS sections, COUNT(DISTINCT course_id) AS courses
      FROM tc GROUP BY teacher_id) o ON o.teacher_id = t.teacher_id
LEFT JOIN (SELECT teacher_id, COUNT(DISTINCT student_id) AS students, COUNT(*) AS enrolments,
        COUNT(score) AS graded, AVG(score) AS avg_score,
        CAST(COUNT(CASE WHEN score >= 60 THEN 1 END) AS DOUBLE) / NULLIF(COUNT(score), 0) AS pass_rate
      FROM sc GROUP BY teacher_id) r ON r.teacher_id = t.teacher_id""",
    "student_statistics": """
SELECT s.student_id, s.name AS student_name, COALESCE(r.enrolments, 0) AS enrolments,
  COALESCE(r.graded, 0) AS graded, r.avg_score, r.max_score, r.min_score, COALESCE(r.passed, 0) AS passed,
  COALESCE(r.failed, 0) AS failed, CAST(COALESCE(e.earned_credits, 0) AS BIGINT) AS earned_credits
FROM student s
LEFT JOIN (SELECT student_id, COUNT(*) AS enrolments, COUNT(score) AS graded, AVG(score) AS avg_score,
        MAX(score) AS max_score, MIN(score) AS min_score, COUNT(CASE WHEN score >= 60 THEN 1 END) AS passed,
        COUNT(CASE WHEN score < 60 THEN 1 END) AS failed
      FROM chosen GROUP BY student_id) r ON r.student_id = s.student_id
LEFT JOIN (SELECT student_id, SUM(credits) AS earned_credits
      FROM (SELECT DISTINCT student_id, course_id FROM chosen WHERE score >= 60) p
      JOIN course USING (course_id) GROUP BY student_id) e ON e.student_id = s.student_id""",
}
_CTES: dict[str, list[str]] = {"student_statistics": ["chosen AS (SELECT * FROM sc)"]}

_READS["course_statistics_semester"] = f"SELECT * FROM ({_READS['course_statistics']}) x WHERE semester = '2000春'"
_READS["teacher_statistics_department"] = (
    _READS["teacher_statistics"]
    .replace("FROM tc GROUP", "FROM tc WHERE semester = '1997秋' GROUP")
    .replace("FROM sc GROUP", "FROM sc WHERE semester = '1997秋' GROUP")
    + "\nWHERE LOWER(t.department) = 'nation_3'"
)
_READS["student_statistics_semester"] = _READS["student_statistics"]
_CTES["student_statistics_semester"] = ["chosen AS (SELECT * FROM sc WHERE semester = '1996春')"]
_READS["grade_report"] = "SELECT " + ", ".join(
    f"COALESCE(CAST({c.strip()} AS STRING), '未录入') AS {c.strip()}" for c in _GRADE_COLUMNS.split(",")
) + " FROM grades"
_READS["credit_card"] = f"""
SELECT * REPLACE (COALESCE(overall_gpa, 0) AS overall_gpa) FROM ({_READS["credit_summary"]}) x"""


# ------------------------------------------------------------------ change batches

_ENROLMENT = "student_id, course_id, semester"
_SECTION = "teacher_id, course_id, semester"
_LONG = "table_name, username, student_id, teacher_id, course_id, semester"


def _ranked(source: str, key: str, order: str = "change_seq") -> str:
    """Valid changes with their rank among the changes to one key."""
    return f"SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY {order}) AS rank FROM {source}"


def _resolved(batch: str, username: str, role: str, id_column: str) -> str:
    return f"""resolved AS (
  SELECT b.*, u.user_id AS {id_column} FROM {batch} b
  LEFT JOIN users u ON LOWER(u.username) = LOWER(b.{username}) AND u.role = '{role}')"""


def _exists(table: str, key: str, alias: str = "r") -> str:
    same = " AND ".join(f"x.{c.strip()} = {alias}.{c.strip()}" for c in key.split(","))
    return f"EXISTS (SELECT 1 FROM {table} x WHERE {same})"


def _judged(key: str, order: str, source: str = "checked") -> list[str]:
    """From ``checked`` (changes with a reason or NULL) to winners and rejects."""
    return [
        f"valid AS ({_ranked(f'(SELECT * FROM {source} WHERE reason IS NULL) v', key, order)})",
        "won AS (SELECT * FROM valid WHERE rank = 1)",
        f"""refused AS (
  SELECT * EXCLUDE (rank) REPLACE ('superseded' AS reason) FROM valid WHERE rank > 1
  UNION ALL SELECT * FROM {source} WHERE reason IS NOT NULL)""",
    ]


_FIRST, _LAST = "change_seq", "change_seq DESC"
_CHANGES: dict[str, tuple[str, list[str]]] = {}


def _register(name: str, ctes: list[str], rejects: str, **outputs: str) -> None:
    # a change delivered twice is one change
    delivered = ctes[0].replace("batch AS (", "delivered AS (", 1)
    ctes = [delivered, "batch AS (SELECT DISTINCT * FROM delivered)", *ctes[1:]]
    for suffix, body in outputs.items():
        key = name if suffix == "main" else f"{name}_{suffix}"
        _CHANGES[key] = (body, ctes)
    _CHANGES[f"{name}_rejects"] = (f"SELECT {rejects}, reason FROM refused", ctes)


# add_users
_CUSTOMER_CHANGE = """
  SELECT {seq} AS change_seq, {id} AS user_id, CONCAT('{name}', CAST(k AS STRING)) AS username,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'dean' ELSE 'Student' END AS role, c_name AS name,
    CASE WHEN k % 3 = 0 THEN '' ELSE '女' END AS gender,
    CASE k % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN '2005-06' WHEN 2 THEN '2005-06-15 or so'
      ELSE '2005-06-15' END AS birth_date,
    CAST(NULL AS STRING) AS department, CAST(NULL AS STRING) AS introduction
  FROM (SELECT *, c_custkey * 2 + 2 AS k FROM customer) c"""
_register(
    "add_users",
    [
        "batch AS ("
        + "\n  UNION ALL".join(
            _CUSTOMER_CHANGE.format(seq=seq, id=i, name=name)
            for seq, i, name in [
                ("k", "-k", "fresh"),
                ("k + 1", "-k", "other"),
                ("-k", "-1000000000000 - k", "FRESH"),
                ("k + 2", "-2000000000000 - k", "STUDENT"),
                ("k + 3", "k", "late"),
            ]
        )
        + """
  UNION ALL SELECT k, -k, CONCAT('guest', CAST(k AS STRING)), 'TEACHER', s_name, NULL, '', 'visitors', ''
  FROM (SELECT *, s_suppkey * 2 + 1 AS k FROM supplier) s)""",
        """checked AS (
  SELECT r.*, CASE
    WHEN user_id IS NULL OR NULLIF(username, '') IS NULL THEN 'invalid_value'
    WHEN COALESCE(LOWER(role), '') NOT IN ('student', 'teacher', 'admin') THEN 'invalid_value'
    WHEN NULLIF(gender, '') NOT IN ('男', '女') THEN 'invalid_value'
    WHEN birth_date <> '' AND (TRY_CAST(birth_date AS DATE) IS NULL OR birth_date NOT LIKE '____-__-__') THEN 'invalid_value'
    WHEN EXISTS (SELECT 1 FROM users u WHERE u.user_id = r.user_id)
      OR EXISTS (SELECT 1 FROM users u WHERE LOWER(u.username) = LOWER(r.username)) THEN 'duplicate'
    END AS reason FROM batch r)""",
        f"by_id AS ({_ranked('(SELECT * FROM checked WHERE reason IS NULL) v', 'user_id')})",
        """by_name AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY LOWER(username) ORDER BY change_seq) AS name_rank
  FROM by_id WHERE rank = 1)""",
        "won AS (SELECT * FROM by_name WHERE name_rank = 1)",
        """refused AS (
  SELECT * FROM checked WHERE reason IS NOT NULL
  UNION ALL SELECT * EXCLUDE (rank) REPLACE ('superseded' AS reason) FROM by_id WHERE rank > 1
  UNION ALL SELECT * EXCLUDE (rank, name_rank) REPLACE ('superseded' AS reason) FROM by_name WHERE name_rank > 1)""",
    ],
    "change_seq, user_id, username, role, name, gender, birth_date, department, introduction",
    main="""SELECT * FROM users
UNION ALL SELECT user_id, username, LOWER(role) FROM won""",
    student="""SELECT * FROM student
UNION ALL SELECT user_id, NULLIF(name, ''), NULLIF(gender, ''), TRY_CAST(NULLIF(birth_date, '') AS DATE)
FROM won WHERE LOWER(role) = 'student'""",
    teacher="""SELECT * FROM teacher
UNION ALL SELECT user_id, NULLIF(name, ''), NULLIF(department, ''), NULLIF(introduction, '')
FROM won WHERE LOWER(role) = 'teacher'""",
)

# delete_users
_register(
    "delete_users",
    [
        """batch AS (
  SELECT CAST(1 AS BIGINT) AS change_seq,
    CONCAT(CASE WHEN c_acctbal < 0 THEN 'STUDENT' ELSE 'ghost' END, CAST(c_custkey * 2 + 2 AS STRING)) AS username
  FROM customer
  UNION ALL SELECT 2, CONCAT(CASE WHEN c_acctbal < 0 THEN 'student' ELSE 'ghost' END, CAST(c_custkey * 2 + 2 AS STRING))
  FROM customer
  UNION ALL SELECT 1, CONCAT(CASE WHEN s_acctbal < 0 THEN 'Teacher' ELSE 'ghost' END, CAST(s_suppkey * 2 + 1 AS STRING))
  FROM supplier)""",
        """checked AS (
  SELECT r.*, CASE WHEN NOT EXISTS (SELECT 1 FROM users u WHERE LOWER(u.username) = LOWER(r.username))
    THEN 'unknown_user' END AS reason FROM batch r)""",
        *_judged("LOWER(username)", _FIRST),
        "gone AS (SELECT * FROM users WHERE LOWER(username) IN (SELECT LOWER(username) FROM won))",
        "ids AS (SELECT user_id FROM gone)",
    ],
    "change_seq, username",
    main="SELECT * FROM users WHERE user_id NOT IN (FROM ids)",
    student="SELECT * FROM student WHERE student_id NOT IN (FROM ids)",
    teacher="SELECT * FROM teacher WHERE teacher_id NOT IN (FROM ids)",
    tc="SELECT * FROM tc WHERE teacher_id NOT IN (FROM ids)",
    sc="SELECT * FROM sc WHERE student_id NOT IN (FROM ids) AND teacher_id NOT IN (FROM ids)",
    removed=f"""SELECT {_LONG} FROM (
SELECT 'users' AS table_name, username, CAST(NULL AS BIGINT) AS student_id, CAST(NULL AS BIGINT) AS teacher_id,
  CAST(NULL AS BIGINT) AS course_id, CAST(NULL AS STRING) AS semester FROM gone
UNION ALL SELECT 'student', NULL, student_id, NULL, NULL, NULL FROM student WHERE student_id IN (FROM ids)
UNION ALL SELECT 'teacher', NULL, NULL, teacher_id, NULL, NULL FROM teacher WHERE teacher_id IN (FROM ids)
UNION ALL SELECT 'tc', NULL, NULL, teacher_id, course_id, semester FROM tc WHERE teacher_id IN (FROM ids)
UNION ALL SELECT 'sc', NULL, student_id, teacher_id, course_id, semester FROM sc
  WHERE student_id IN (FROM ids) OR teacher_id IN (FROM ids)) x""",
)

# upsert_courses
_register(
    "upsert_courses",
    [
        """batch AS (
  SELECT course_id * 2 AS change_seq, course_id,
    CASE WHEN course_id % 7 = 0 THEN NULL WHEN course_id % 7 = 1 THEN '' ELSE CONCAT(name, ' II') END AS name, description,
    CASE course_id % 9 WHEN 0 THEN 'many' WHEN 1 THEN '3.5' WHEN 2 THEN '4 '
      ELSE CAST((credits + 3) % 13 AS STRING) END AS credits FROM course
  UNION ALL SELECT course_id * 2 + 1, course_id, CONCAT(name, ' III'), '', CAST(credits * 2 AS STRING) FROM course
  UNION ALL SELECT course_id * 2, -1 - course_id, CONCAT('new ', name), description, CAST(credits AS STRING) FROM course)""",
        """checked AS (
  SELECT r.*, CASE WHEN NULLIF(name, '') IS NULL OR COALESCE(TRY_CAST(credits AS INT), 0) NOT BETWEEN 1 AND 10
    OR NOT regexp_full_match(credits, '[0-9]+') THEN 'invalid_value' END AS reason FROM batch r)""",
        *_judged("course_id", _LAST),
    ],
    "change_seq, course_id, name, description, credits",
    main=f"""SELECT * FROM course r WHERE NOT {_exists("won", "course_id")}
UNION ALL SELECT course_id, name, NULLIF(description, ''), CAST(credits AS INT) FROM won""",
)

# delete_courses
_register(
    "delete_courses",
    [
        """batch AS (
  SELECT CAST(n AS BIGINT) AS change_seq, CASE WHEN p_size > 40 THEN p_partkey ELSE -1 - p_partkey END AS course_id
  FROM part, (VALUES (1), (2)) t(n))""",
        f"checked AS (SELECT r.*, CASE WHEN NOT {_exists('course', 'course_id')} THEN 'no_such_row' END AS reason FROM batch r)",
        *_judged("course_id", _FIRST),
    ],
    "change_seq, course_id",
    main=f"SELECT * FROM course r WHERE NOT {_exists('won', 'course_id')}",
    tc=f"SELECT * FROM tc r WHERE NOT {_exists('won', 'course_id')}",
    sc=f"SELECT * FROM sc r WHERE NOT {_exists('won', 'course_id')}",
    removed=f"""SELECT {_LONG} FROM (
SELECT 'course' AS table_name, CAST(NULL AS STRING) AS username, CAST(NULL AS BIGINT) AS student_id,
  CAST(NULL AS BIGINT) AS teacher_id, course_id, CAST(NULL AS STRING) AS semester
FROM course r WHERE {_exists("won", "course_id")}
UNION ALL SELECT 'tc', NULL, NULL, teacher_id, course_id, semester FROM tc r WHERE {_exists("won", "course_id")}
UNION ALL SELECT 'sc', NULL, student_id, teacher_id, course_id, semester FROM sc r WHERE {_exists("won", "course_id")}) x""",
)

# add_sections
_register(
    "add_sections",
    [
        f"""batch AS (
  SELECT {_SEMESTER_NO} AS change_seq, {_SECTION} FROM tc
  UNION ALL SELECT {_SEMESTER_NO}, teacher_id, course_id, '2004春' FROM tc
  UNION ALL SELECT {_SEMESTER_NO}, teacher_id, course_id, '' FROM tc
  UNION ALL SELECT {_SEMESTER_NO}, teacher_id + 1, course_id, semester FROM tc)""",
        f"""checked AS (
  SELECT r.*, CASE WHEN NULLIF(semester, '') IS NULL THEN 'invalid_value'
    WHEN NOT {_exists("teacher", "teacher_id")} OR NOT {_exists("course", "course_id")} THEN 'no_such_row'
    WHEN {_exists("tc", _SECTION)} THEN 'duplicate' END AS reason FROM batch r)""",
        *_judged(_SECTION, _FIRST),
    ],
    f"change_seq, {_SECTION}",
    main=f"SELECT * FROM tc UNION ALL SELECT {_SECTION} FROM won",
)

# delete_sections
_register(
    "delete_sections",
    [
        """batch AS (
  SELECT CAST(n AS BIGINT) AS change_seq,
    CASE WHEN semester LIKE '1996%' THEN teacher_id ELSE teacher_id + 1 END AS teacher_id, course_id, semester
  FROM tc, (VALUES (1), (2)) t(n))""",
        f"checked AS (SELECT r.*, CASE WHEN NOT {_exists('tc', _SECTION)} THEN 'no_such_row' END AS reason FROM batch r)",
        *_judged(_SECTION, _FIRST),
    ],
    f"change_seq, {_SECTION}",
    main=f"SELECT * FROM tc r WHERE NOT {_exists('won', _SECTION)}",
    sc=f"SELECT * FROM sc r WHERE NOT {_exists('won', _SECTION)}",
    removed=f"""SELECT {_LONG} FROM (
SELECT 'tc' AS table_name, CAST(NULL AS STRING) AS username, CAST(NULL AS BIGINT) AS student_id,
  teacher_id, course_id, semester FROM tc r WHERE {_exists("won", _SECTION)}
UNION ALL SELECT 'sc', NULL, student_id, teacher_id, course_id, semester FROM sc r WHERE {_exists("won", _SECTION)}) x""",
)

# enrol
_ACCOUNT = """CONCAT(CASE WHEN student_id % 13 = 5 THEN 'ghost' WHEN student_id % 13 = 6 THEN 'teacher' ELSE 'Student' END,
      CAST(CASE WHEN student_id % 13 = 6 THEN teacher_id ELSE student_id END AS STRING))"""
_register(
    "enrol",
    [
        f"""batch AS (
  SELECT {_SEMESTER_NO} AS change_seq, {_ACCOUNT} AS student_username, teacher_id, course_id, semester FROM sc
  UNION ALL SELECT {_SEMESTER_NO}, {_ACCOUNT},
    ((course_id * 31 + 4006 * 7) % (SELECT n FROM active)) * 2 + 1, course_id, '2003春' FROM sc)""",
        _resolved("batch", "student_username", "student", "student_id"),
        f"""checked AS (
  SELECT r.*, CASE WHEN student_id IS NULL THEN 'unknown_user'
    WHEN NOT {_exists("tc", _SECTION)} THEN 'no_such_row'
    WHEN {_exists("sc", _ENROLMENT)} THEN 'duplicate' END AS reason FROM resolved r)""",
        *_judged(_ENROLMENT, _FIRST),
    ],
    f"change_seq, student_username, {_SECTION}",
    main=f"SELECT * FROM sc UNION ALL SELECT {_ENROLMENT}, teacher_id, NULL FROM won",
)

# drop
_register(
    "drop",
    [
        """batch AS (
  SELECT CAST(n AS BIGINT) AS change_seq,
    CONCAT(CASE WHEN student_id % 13 = 6 THEN 'ghost' ELSE 'STUDENT' END, CAST(student_id AS STRING)) AS student_username,
    course_id, CASE WHEN score < 20 THEN semester ELSE '1990春' END AS semester
  FROM sc, (VALUES (1), (2)) t(n))""",
        _resolved("batch", "student_username", "student", "student_id"),
        f"""checked AS (
  SELECT r.*, CASE WHEN student_id IS NULL THEN 'unknown_user'
    WHEN NOT {_exists("sc", _ENROLMENT)} THEN 'no_such_row' END AS reason FROM resolved r)""",
        *_judged(_ENROLMENT, _FIRST),
    ],
    "change_seq, student_username, course_id, semester",
    main=f"SELECT * FROM sc r WHERE NOT {_exists('won', _ENROLMENT)}",
)

# upsert_grades
_register(
    "upsert_grades",
    [
        """batch AS (
  SELECT CAST(1 AS BIGINT) AS change_seq,
    CASE WHEN student_id % 22 = 0 THEN CONCAT('teacher', CAST(teacher_id + 2 AS STRING))
         WHEN student_id % 26 = 2 THEN CONCAT('student', CAST(student_id AS STRING))
         ELSE CONCAT('TEACHER', CAST(teacher_id AS STRING)) END AS teacher_username,
    student_id, course_id, semester,
    CASE COALESCE(score, 41) % 17 WHEN 0 THEN 'good' WHEN 1 THEN CONCAT(CAST(COALESCE(score, 41) AS STRING), '.9')
      WHEN 2 THEN '100.7' ELSE CAST((COALESCE(score, 41) * 7) % 121 AS STRING) END AS score
  FROM sc
  UNION ALL SELECT 2, CONCAT('teacher', CAST(teacher_id AS STRING)), student_id, course_id, semester,
    CAST((COALESCE(score, 41) * 3) % 131 AS STRING) FROM sc)""",
        _resolved("batch", "teacher_username", "teacher", "teacher_id"),
        f"""checked AS (
  SELECT r.*, CASE WHEN COALESCE(TRY_CAST(score AS INT), -1) NOT BETWEEN 0 AND 100
      OR NOT regexp_full_match(score, '[0-9]+') THEN 'invalid_value'
    WHEN teacher_id IS NULL THEN 'unknown_user'
    WHEN NOT {_exists("sc", _ENROLMENT + ", teacher_id")} THEN 'no_such_row' END AS reason FROM resolved r)""",
        *_judged(_ENROLMENT, _LAST),
    ],
    "change_seq, teacher_username, student_id, course_id, semester, score",
    main=f"""SELECT * FROM sc r WHERE NOT {_exists("won", _ENROLMENT)}
UNION ALL SELECT {_ENROLMENT}, teacher_id, CAST(score AS INT) FROM won""",
)

# delete_grades
_register(
    "delete_grades",
    [
        """batch AS (
  SELECT CAST(n AS BIGINT) AS change_seq, CASE WHEN score >= 90 THEN teacher_id ELSE teacher_id + 2 END AS teacher_id,
    student_id, course_id, semester
  FROM sc, (VALUES (1), (2)) t(n))""",
        f"""checked AS (
  SELECT r.*, CASE WHEN NOT {_exists("sc", _ENROLMENT + ", teacher_id")} THEN 'no_such_row' END AS reason FROM batch r)""",
        *_judged(_ENROLMENT, _FIRST),
    ],
    "change_seq, teacher_id, student_id, course_id, semester",
    main=f"""SELECT {_ENROLMENT}, teacher_id,
  CASE WHEN {_exists("won", _ENROLMENT)} THEN NULL ELSE score END AS score FROM sc r""",
)

# update_student_profiles
_register(
    "update_student_profiles",
    [
        """batch AS (
  SELECT CAST(1 AS BIGINT) AS change_seq,
    CASE WHEN student_id % 11 = 0 THEN CONCAT('teacher', CAST(student_id + 1 AS STRING))
         ELSE CONCAT('student', CAST(student_id AS STRING)) END AS student_username,
    CASE WHEN student_id % 3 = 0 THEN 'x' ELSE '女' END AS gender, '2001-02-03' AS birth_date FROM student
  UNION ALL SELECT 2, CONCAT('STUDENT', CAST(student_id AS STRING)), '',
    CASE student_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'soon' WHEN 2 THEN '2002'
      WHEN 3 THEN '2002-03-04 junk' ELSE '2002-03-04' END FROM student)""",
        _resolved("batch", "student_username", "student", "student_id"),
        """checked AS (
  SELECT r.*, CASE WHEN NULLIF(gender, '') NOT IN ('男', '女') THEN 'invalid_value'
    WHEN birth_date <> '' AND (TRY_CAST(birth_date AS DATE) IS NULL OR birth_date NOT LIKE '____-__-__') THEN 'invalid_value'
    WHEN student_id IS NULL THEN 'unknown_user' END AS reason FROM resolved r)""",
        *_judged("student_id", _LAST),
    ],
    "change_seq, student_username, gender, birth_date",
    main=f"""SELECT * FROM student r WHERE NOT {_exists("won", "student_id")}
UNION ALL SELECT s.student_id, s.name, NULLIF(w.gender, ''), TRY_CAST(w.birth_date AS DATE)
FROM student s JOIN won w ON w.student_id = s.student_id""",
)

# update_teacher_profiles
_register(
    "update_teacher_profiles",
    [
        """batch AS (
  SELECT CAST(1 AS BIGINT) AS change_seq,
    CASE WHEN teacher_id % 11 = 0 THEN CONCAT('student', CAST(teacher_id + 1 AS STRING))
         ELSE CONCAT('teacher', CAST(teacher_id AS STRING)) END AS teacher_username,
    'Physics' AS department, '' AS introduction FROM teacher
  UNION ALL SELECT 2, CONCAT('Teacher', CAST(teacher_id AS STRING)),
    CASE WHEN teacher_id % 3 = 0 THEN '' ELSE department END, CONCAT('new ', name) FROM teacher)""",
        _resolved("batch", "teacher_username", "teacher", "teacher_id"),
        """checked AS (
  SELECT r.*, CASE WHEN NULLIF(department, '') IS NULL THEN 'invalid_value'
    WHEN teacher_id IS NULL THEN 'unknown_user' END AS reason FROM resolved r)""",
        *_judged("teacher_id", _LAST),
    ],
    "change_seq, teacher_username, department, introduction",
    main=f"""SELECT * FROM teacher r WHERE NOT {_exists("won", "teacher_id")}
UNION ALL SELECT t.teacher_id, t.name, w.department, NULLIF(w.introduction, '')
FROM teacher t JOIN won w ON w.teacher_id = t.teacher_id""",
)

_BODY, _WITH = _CHANGES["delete_sections_sc"]
_CHANGES["snapshot_semesters"] = (
    f"""SELECT semester, COUNT(*) AS enrolments, COUNT(score) AS graded,
  CAST(SUM(score) AS BIGINT) AS score_sum FROM ({_BODY}) kept GROUP BY semester""",
    _WITH,
)

ORACLE: dict[str, str] = {
    **{name: _sql(body.strip(), *_CTES.get(name, [])) for name, body in _READS.items()},
    **{name: _sql(body.strip(), *ctes) for name, (body, ctes) in _CHANGES.items()},
}
