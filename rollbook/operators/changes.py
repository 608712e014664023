"""Batches of changes applied to a snapshot.

Every operator takes a DataFrame of changes and returns an :class:`Outcome`: the
new snapshot, the rejected changes with a reason and, for deletions, the rows
removed. Nothing is modified in place; a caller writes the new tables beside the
old ones. An operator stages its batch at once; its outputs are planned, and what
only they need is staged, when they are first asked for.

``change_seq`` orders the changes to one key and may not be NULL. A change
delivered twice with the same content is one change, accepted once or refused once.
Of several valid changes to a key the first wins where rows are added or removed,
the last where they are updated; the others are ``superseded``. Changes are judged
against the old snapshot.

How hot keys are kept apart, whatever share of the batch they hold:

* the winning change per key is an aggregate, reduced before the shuffle;
* losing changes are told from it by a join on key and ``change_seq``, whose hash
  spreads the changes to one key over all partitions, or by the next;
* lookups left join many changes (left) with one row per key (right), the form in
  which adaptive execution splits a skewed left side.

Changes to enrolments are merged in one pass: they are reduced to the least and the
greatest per key, meet the table's keys by the same partitioning, and what comes out is
staged as a verdict. Where these two are all changes to a key, and no more than the
verdict is needed to tell those refused, the batch is not shuffled again. The changes to
other keys, however many, are told by a join with their verdicts and made distinct.

How a small batch stays cheap on a large table: the batch is staged once it is
cleaned and its account names are looked up, so it is computed once and the plans
that follow know its size: staged files are plain, so that they are as large as the
rows. What is joined to a table then is broadcast if it is small, and the table is
neither sorted nor shuffled. Lookups in the other direction first narrow the table to
the keys of the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache, cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.functions.filters import blank_to_null, same_text, to_int
from rollbook.operators.sections import SECTION_KEY
from rollbook.rules import DEFAULT_RULES, GradeRules
from rollbook.school import School
from rollbook.sources.staging import is_small, stage

ENROLMENT_KEY = ["student_id", "course_id", "semester"]
GRADED_KEY = [*ENROLMENT_KEY, "teacher_id"]

INVALID_VALUE = "invalid_value"
UNKNOWN_USER = "unknown_user"
NO_SUCH_ROW = "no_such_row"
DUPLICATE = "duplicate"
SUPERSEDED = "superseded"


class Outcome:
    """``school``: the new snapshot; ``rejects``: refused changes with ``reason``;
    ``removed``: keys of the rows a deletion took away; ``semesters``: a frame of the
    semesters in which rows of sc or tc may differ, or None if any may.

    Each is made when it is first asked for."""

    def __init__(
        self,
        school: Callable[[], School],
        rejects: Callable[[], DataFrame],
        removed: Callable[[], DataFrame] | None = None,
        semesters: Callable[[], DataFrame] | None = None,
    ):
        self._school, self._rejects = school, rejects
        self._removed, self._semesters = removed, semesters

    @cached_property
    def school(self) -> School:
        return self._school()

    @cached_property
    def rejects(self) -> DataFrame:
        return self._rejects()

    @cached_property
    def removed(self) -> DataFrame | None:
        return None if self._removed is None else self._removed()

    @cached_property
    def semesters(self) -> DataFrame | None:
        return None if self._semesters is None else self._semesters()


# ---------------------------------------------------------------- building blocks


def _any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))


def _one_of(column: str, values: Sequence[str]) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def _judge(changes: DataFrame, *checks: tuple[Column, str]) -> tuple[DataFrame, DataFrame]:
    """Split by the first check that holds: (sound, faulty with ``reason``)."""
    checks = ((F.col("change_seq").isNull(), INVALID_VALUE), *checks)
    reason = F.coalesce(*(F.when(condition, F.lit(text)) for condition, text in checks))
    sound = changes.filter(reason.isNull())
    faulty = changes.withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return sound, faulty


def _winners(changes: DataFrame, key: Sequence[str], keep: str) -> DataFrame:
    """The first or last change per key."""
    extreme = {"first": F.min, "last": F.max}[keep]
    rest = [c for c in changes.columns if c not in key and c != "change_seq"]
    if not rest:
        return changes.groupBy(*key).agg(extreme("change_seq").alias("change_seq"))
    return (
        changes.groupBy(*key)
        .agg(extreme(F.struct("change_seq", *rest)).alias("won"))
        .select(*key, "won.*")
        .select(*changes.columns)
    )


def _batch(changes: DataFrame) -> DataFrame:
    """The distinct changes, staged."""
    return stage(changes.distinct(), "changes", plain=True)


def _verdicts(
    sound: DataFrame, key: Sequence[str], table: DataFrame, batch: DataFrame, lead: Sequence[str] = ()
) -> DataFrame:
    """The verdict on each key of the batch, staged.

    ``_first`` is the least change without its key, in the order of ``lead``, then of
    ``change_seq``, then of the rest; ``_last`` the greatest if it is another one, else
    NULL; ``_crowded`` tells whether there may be more between them; ``_there`` is TRUE
    where the key is in the table, else NULL. ``batch`` is the staged one.
    """
    rest = [c for c in sound.columns if c not in (*key, *lead, "change_seq")]
    fields = [*lead, "change_seq", *rest]
    change = F.struct(*fields) if len(fields) > 1 else F.col("change_seq")
    ends = sound.groupBy(*key).agg(
        F.min(change).alias("_first"), F.max(change).alias("_last"), F.count("*").alias("_many")
    )
    if len(fields) == 1:
        ends = ends.withColumns({c: F.struct(F.col(c).alias(*fields)) for c in ("_first", "_last")})
    several = ~F.col("_first").eqNullSafe(F.col("_last"))
    ends = ends.select(
        *key,
        "_first",
        F.when(several, F.col("_last")).alias("_last"),
        (several & (F.col("_many") > 2)).alias("_crowded"),
    )
    known = _known(table, batch, sound, key).distinct()
    return stage(_marked(ends, known, key, "_there"), "verdicts", sized=True)


def _won(keep: str) -> Column:
    """The winner of a verdict's key."""
    return F.col("_first") if keep == "first" else F.coalesce("_last", "_first")


def _refused(
    columns: Sequence[str],
    faulty: DataFrame,
    sound: DataFrame,
    key: Sequence[str],
    verdicts: DataFrame,
    keep: str,
    *checks: tuple[Column, str],
    told_by: Sequence[str] = (),
    flagged: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    unique: bool = True,
) -> DataFrame:
    """All refused changes in the shape they came in, plus ``reason``, each once.

    ``faulty`` are those refused on their own; the checks read what the verdict says of a
    sound one, and what ``flagged`` adds to it. What passes them without being the winner
    of its key, by the columns ``told_by`` or all, is superseded. ``unique`` says that
    changes to different keys differ in ``columns``.
    """
    fields = verdicts.schema["_first"].dataType.names
    won = [F.col(c).eqNullSafe(F.col("_won")[c]) for c in told_by or fields]
    reason = F.coalesce(
        *(F.when(condition, F.lit(text)) for condition, text in checks),
        F.when(~reduce(lambda a, b: a & b, won), F.lit(SUPERSEDED)),
    )

    def told(rows: DataFrame) -> DataFrame:
        judged = rows.withColumn("reason", reason).filter(F.col("reason").isNotNull())
        return judged.select(*columns, "reason")

    verdicts = verdicts.withColumn("_won", _won(keep))
    ends = F.inline(F.array_compact(F.array("_first", "_last")))
    settled = told(verdicts.filter(~F.col("_crowded")).select(*key, "_won", "_there", ends))
    others = faulty.select(*columns, "reason")
    crowded = verdicts.filter("_crowded").select(*key, "_won", "_there")
    crowded = stage(crowded, "crowded", plain=True)
    if not crowded.isEmpty():
        others = others.unionByName(told(flagged(sound.join(crowded, list(key)))))
    if unique:
        return settled.unionByName(others.distinct())
    return settled.unionByName(others).distinct()


def _known(table: DataFrame, batch: DataFrame, rows: DataFrame, on: Sequence[str]) -> DataFrame:
    """The keys in the table, narrowed to those of the rows if their batch, a staged one, is
    small. A large one is shuffled to meet the table in any case; narrowing adds to that."""
    return _narrowed(table, rows, on) if is_small(batch) else table.select(*on)


def _narrowed(table: DataFrame, batch: DataFrame, on: Sequence[str]) -> DataFrame:
    """The keys in the table that the batch can meet, staged: no more than the batch has.

    A join with it is then one of two tables, which adaptive execution can split.
    """
    asked = batch.select(*on).distinct()
    return stage(_matched(table.select(*on), asked, on), "met", plain=True)


def _matched(rows: DataFrame, others: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key occurs among the others."""
    return rows.join(others.select(*on), list(on), "left_semi")


def _unmatched(rows: DataFrame, others: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key does not, columns in their order."""
    return rows.join(others.select(*on), list(on), "left_anti").select(*rows.columns)


def _marked(rows: DataFrame, keys: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """Add ``flag``: TRUE where the key is among the unique keys, else NULL."""
    return rows.join(keys.select(*on, F.lit(True).alias(flag)), list(on), "left")


def _rejects(
    columns: Sequence[str],
    faulty: DataFrame,
    marked: DataFrame,
    key: Sequence[str],
    winners: DataFrame,
    *checks: tuple[Column, str],
) -> DataFrame:
    """All refused changes in the shape they came in, plus ``reason``.

    ``faulty`` are those refused on their own, ``marked`` the sound ones with the
    flags the checks read. What passes the checks without being a winner is
    superseded.
    """
    rest = [c for c in winners.columns if c not in key and c != "change_seq"]
    # of two changes alike in key and change_seq the rest tells which one won
    content = F.struct(*rest) if rest else F.lit(True)
    won = winners.select(*key, "change_seq", content.alias("_won"))
    is_winner = content.eqNullSafe(F.col("_won"))
    reason = F.coalesce(
        *(F.when(condition, F.lit(text)) for condition, text in checks),
        F.when(~is_winner, F.lit(SUPERSEDED)),
    )
    lost = marked.join(won, [*key, "change_seq"], "left").withColumn("reason", reason)
    return faulty.select(*columns, "reason").unionByName(
        lost.filter(F.col("reason").isNotNull()).select(*columns, "reason")
    )


def _absent(flag: str) -> Column:
    return F.col(flag).isNull()


def _resolved(
    changes: DataFrame, school: School, username: str, role: str, id_column: str
) -> DataFrame:
    """Changes with the id behind an account name; NULL if none has the role."""
    accounts = school.users.filter(same_text("role", role)).select(
        F.lower("username").alias("_account"), F.col("user_id").alias(id_column)
    )
    named = changes.join(accounts, F.lower(changes[username]) == accounts["_account"], "left")
    return named.drop("_account")


def _named_once(school: School, role: str) -> bool:
    """Whether no two ids of the role share an account name."""
    accounts = school.users.filter(same_text("role", role)).groupBy(F.lower("username"))
    ends = accounts.agg(F.min("user_id").alias("least"), F.max("user_id").alias("greatest"))
    return ends.filter("least <> greatest").isEmpty()


def _with_account(changes: DataFrame, *lookup) -> DataFrame:
    """The same, distinct and staged."""
    return _batch(_resolved(changes, *lookup))


def _as_delivered(changes: DataFrame, light: bool = True) -> DataFrame:
    """The changes, staged; equal ones are told apart by no step that follows. ``light`` if
    they are reduced per key as they are read."""
    return stage(changes, "changes", sized=True, light=light)


def _clean(changes: DataFrame, texts: Sequence[str] = (), ints: Sequence[str] = ()) -> DataFrame:
    """Add ``_new_*`` columns with blanks as NULL and numbers read; originals stay."""
    copies = changes.withColumns({f"_new_{c}": F.col(c) for c in (*texts, *ints)})
    copies = blank_to_null(copies, [f"_new_{c}" for c in texts])
    return to_int(copies, [f"_new_{c}" for c in ints])


def _with_date(changes: DataFrame, column: str) -> DataFrame:
    """Add ``_new_*`` with text of the form year-month-day read as a date; originals stay."""
    text = F.col(column).cast("string")
    whole = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    return changes.withColumn(f"_new_{column}", whole.try_cast(T.DateType()))


def _bad_date(column: str) -> Column:
    text = F.nullif(F.col(column).cast("string"), F.lit(""))
    return text.isNotNull() & F.col(f"_new_{column}").isNull()


def _removed(table: str, rows: DataFrame) -> DataFrame:
    """Keys of removed rows in the long form shared by all tables."""
    columns = ["username", "student_id", "teacher_id", "course_id", "semester"]
    keys = [c for c in columns if c in rows.columns]
    return rows.select(F.lit(table).alias("table_name"), *keys)


def _semesters(rows: DataFrame) -> DataFrame:
    """The semesters named, which a change to sc or tc stays within."""
    return rows.select("semester").distinct()


def _long_form(school: School, parts: Sequence[DataFrame]) -> DataFrame:
    """Union of :func:`_removed` frames, absent keys NULL."""
    frame = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    for table, column in (
        (school.users, "username"),
        (school.student, "student_id"),
        (school.teacher, "teacher_id"),
        (school.course, "course_id"),
        (school.tc, "semester"),
    ):
        if column not in frame.columns:
            frame = frame.withColumn(column, F.lit(None).cast(table.schema[column].dataType))
    return frame.select(
        "table_name", "username", "student_id", "teacher_id", "course_id", "semester"
    )


# ---------------------------------------------------------------- users


def add_users(school: School, changes: DataFrame, rules: GradeRules = DEFAULT_RULES) -> Outcome:
    """New accounts with their student or teacher record.

    changes: change_seq, user_id, username, role, name, gender, birth_date,
    department, introduction. The id and the account name must both be new; the
    first change wins per id and then, among those, per account name.
    """
    texts = ["username", "role", "name", "gender", "department", "introduction"]
    batch = _with_date(_clean(changes, texts), "birth_date")
    batch = batch.withColumns(
        {"_new_role": F.lower("_new_role"), "_account": F.lower("_new_username")}
    )
    sound, faulty = _judge(
        _batch(batch),
        (_any_null(["user_id", "_account"]), INVALID_VALUE),
        (~_one_of("_new_role", rules.roles), INVALID_VALUE),
        (F.col("_new_gender").isNotNull() & ~_one_of("_new_gender", rules.genders), INVALID_VALUE),
        (_bad_date("birth_date"), INVALID_VALUE),
    )
    names = school.users.select(F.lower("username").alias("_account"))

    @cache
    def used() -> tuple[DataFrame, DataFrame]:
        return _narrowed(school.users, sound, ["user_id"]), _narrowed(names, sound, ["_account"])

    def accepted() -> DataFrame:
        ids, accounts = used()
        valid = _unmatched(_unmatched(sound, ids, ["user_id"]), accounts, ["_account"])
        return _winners(_winners(valid, ["user_id"], "first"), ["_account"], "first")

    def grown() -> School:
        news = accepted()
        users = news.select(
            "user_id", F.col("_new_username").alias("username"), F.col("_new_role").alias("role")
        )
        student = news.filter(F.col("_new_role") == "student").select(
            F.col("user_id").alias("student_id"),
            F.col("_new_name").alias("name"),
            F.col("_new_gender").alias("gender"),
            F.col("_new_birth_date").alias("birth_date"),
        )
        teacher = news.filter(F.col("_new_role") == "teacher").select(
            F.col("user_id").alias("teacher_id"),
            F.col("_new_name").alias("name"),
            F.col("_new_department").alias("department"),
            F.col("_new_introduction").alias("introduction"),
        )
        return school.with_tables(
            users=school.users.unionByName(users),
            student=school.student.unionByName(student),
            teacher=school.teacher.unionByName(teacher),
        )

    def rejects() -> DataFrame:
        ids, accounts = used()
        marked = _marked(sound, ids, ["user_id"], "_id_taken")
        marked = _marked(marked, accounts, ["_account"], "_name_taken")
        taken = ~(_absent("_id_taken") & _absent("_name_taken"))
        return _rejects(
            changes.columns, faulty, marked, ["_account"], accepted(), (taken, DUPLICATE)
        )

    return Outcome(grown, rejects)


def delete_users(school: School, changes: DataFrame) -> Outcome:
    """Remove accounts with everything that hangs on them.

    changes: change_seq, username. A student takes the own enrolments along, a
    teacher the own sections and the enrolments in them.
    """
    batch = _batch(changes.withColumn("_account", F.lower("username")))
    sound, faulty = _judge(batch, (F.col("_account").isNull(), UNKNOWN_USER))
    accounts = school.users.withColumn("_account", F.lower("username"))
    chosen = _winners(sound, ["_account"], "first")

    @cache
    def gone() -> DataFrame:
        found = _matched(accounts, chosen, ["_account"]).select("user_id", "username")
        return stage(found, "gone", plain=True)

    def going(column: str) -> DataFrame:
        return gone().select(F.col("user_id").alias(column))

    def left() -> School:
        students, teachers = going("student_id"), going("teacher_id")
        return school.with_tables(
            users=_unmatched(school.users, gone(), ["user_id"]),
            student=_unmatched(school.student, students, ["student_id"]),
            teacher=_unmatched(school.teacher, teachers, ["teacher_id"]),
            tc=_unmatched(school.tc, teachers, ["teacher_id"]),
            sc=_unmatched(
                _unmatched(school.sc, students, ["student_id"]), teachers, ["teacher_id"]
            ),
        )

    def removed() -> DataFrame:
        students, teachers = going("student_id"), going("teacher_id")
        sc = _marked(school.sc, students, ["student_id"], "_student_gone")
        sc = _marked(sc, teachers, ["teacher_id"], "_teacher_gone")
        return _long_form(
            school,
            [
                _removed("users", gone()),
                _removed("student", _matched(school.student, students, ["student_id"])),
                _removed("teacher", _matched(school.teacher, teachers, ["teacher_id"])),
                _removed("tc", _matched(school.tc, teachers, ["teacher_id"])),
                _removed("sc", sc.filter(~(_absent("_student_gone") & _absent("_teacher_gone")))),
            ],
        )

    return Outcome(
        left,
        lambda: _rejects(
            changes.columns,
            faulty,
            _marked(sound, _narrowed(accounts, sound, ["_account"]), ["_account"], "_known"),
            ["_account"],
            chosen,
            (_absent("_known"), UNKNOWN_USER),
        ),
        removed,
    )


def _update_profiles(
    table: DataFrame,
    batch: DataFrame,
    columns: Sequence[str],
    id_column: str,
    fields: Sequence[str],
    invalid: Column,
) -> tuple[Callable[[], DataFrame], Callable[[], DataFrame]]:
    """What makes the new table and the rejects; every field is overwritten."""
    sound, faulty = _judge(
        batch, (invalid, INVALID_VALUE), (F.col(id_column).isNull(), UNKNOWN_USER)
    )
    won = _winners(sound, [id_column], "last")
    news = won.select(id_column, F.lit(True).alias("_hit"), *(f"_new_{f}" for f in fields))
    values = {f: F.when(F.col("_hit"), F.col(f"_new_{f}")).otherwise(F.col(f)) for f in fields}
    return (
        lambda: table.join(news, id_column, "left").withColumns(values).select(*table.columns),
        lambda: _rejects(
            columns,
            faulty,
            _marked(sound, _narrowed(table, sound, [id_column]), [id_column], "_known"),
            [id_column],
            won,
            (_absent("_known"), NO_SUCH_ROW),
        ),
    )


def update_student_profiles(
    school: School, changes: DataFrame, rules: GradeRules = DEFAULT_RULES
) -> Outcome:
    """Overwrite gender and birth date.

    changes: change_seq, student_username, gender, birth_date. Blank means NULL
    and clears the field.
    """
    batch = _with_date(_clean(changes, ["gender"]), "birth_date")
    batch = _with_account(batch, school, "student_username", "student", "student_id")
    bad_gender = F.col("_new_gender").isNotNull() & ~_one_of("_new_gender", rules.genders)
    student, rejects = _update_profiles(
        school.student,
        batch,
        changes.columns,
        "student_id",
        ["gender", "birth_date"],
        bad_gender | _bad_date("birth_date"),
    )
    return Outcome(lambda: school.with_tables(student=student()), rejects)


def update_teacher_profiles(school: School, changes: DataFrame) -> Outcome:
    """Overwrite department and introduction.

    changes: change_seq, teacher_username, department, introduction. A department
    is required.
    """
    batch = _clean(changes, ["department", "introduction"])
    batch = _with_account(batch, school, "teacher_username", "teacher", "teacher_id")
    teacher, rejects = _update_profiles(
        school.teacher,
        batch,
        changes.columns,
        "teacher_id",
        ["department", "introduction"],
        F.col("_new_department").isNull(),
    )
    return Outcome(lambda: school.with_tables(teacher=teacher()), rejects)


# ---------------------------------------------------------------- courses


def upsert_courses(
    school: School, changes: DataFrame, rules: GradeRules = DEFAULT_RULES
) -> Outcome:
    """Add courses or replace existing ones.

    changes: change_seq, course_id, name, description, credits (number or text).
    """
    batch = _batch(_clean(changes, ["name", "description"], ["credits"]))
    in_range = F.col("_new_credits").between(rules.min_credits, rules.max_credits)
    sound, faulty = _judge(
        batch,
        (_any_null(["course_id", "_new_name"]), INVALID_VALUE),
        (~F.coalesce(in_range, F.lit(False)), INVALID_VALUE),
    )
    won = _winners(sound, ["course_id"], "last")
    news = won.select(
        "course_id", *(F.col(f"_new_{c}").alias(c) for c in ("name", "description", "credits"))
    )
    return Outcome(
        lambda: school.with_tables(
            course=_unmatched(school.course, news, ["course_id"]).unionByName(news)
        ),
        lambda: _rejects(changes.columns, faulty, sound, ["course_id"], won),
    )


def delete_courses(school: School, changes: DataFrame) -> Outcome:
    """Remove courses with their sections and enrolments. changes: change_seq, course_id."""
    return _delete(school, changes, ["course_id"], ["course", "tc", "sc"])


# ---------------------------------------------------------------- sections


def add_sections(school: School, changes: DataFrame) -> Outcome:
    """Assign teachers to courses. changes: change_seq, teacher_id, course_id, semester.

    Whether a change is acceptable depends on nothing but its section key, so the
    changes shrink to one per key before they meet the tables.
    """
    sound, faulty = _judge(
        _batch(changes),
        (F.nullif(F.col("semester"), F.lit("")).isNull(), INVALID_VALUE),
        (_any_null(["teacher_id", "course_id"]), NO_SUCH_ROW),
    )
    chosen = _winners(sound.select("change_seq", *SECTION_KEY), SECTION_KEY, "first")

    @cache
    def known() -> tuple[DataFrame, DataFrame, DataFrame]:
        return (
            _narrowed(school.teacher, sound, ["teacher_id"]),
            _narrowed(school.course, sound, ["course_id"]),
            _narrowed(school.tc, sound, SECTION_KEY),
        )

    def grown() -> School:
        teachers, courses, sections = known()
        news = _matched(_matched(chosen, teachers, ["teacher_id"]), courses, ["course_id"])
        news = _unmatched(news, sections, SECTION_KEY).select(*school.tc.columns)
        return school.with_tables(tc=school.tc.unionByName(news))

    def marked() -> DataFrame:
        teachers, courses, sections = known()
        rows = _marked(sound, teachers, ["teacher_id"], "_teacher_known")
        rows = _marked(rows, courses, ["course_id"], "_course_known")
        return _marked(rows, sections, SECTION_KEY, "_taken")

    return Outcome(
        grown,
        lambda: _rejects(
            changes.columns,
            faulty,
            marked(),
            SECTION_KEY,
            chosen,
            (_absent("_teacher_known") | _absent("_course_known"), NO_SUCH_ROW),
            (~_absent("_taken"), DUPLICATE),
        ),
        semesters=lambda: _semesters(chosen),
    )


def delete_sections(school: School, changes: DataFrame) -> Outcome:
    """Remove sections with their enrolments.

    changes: change_seq, teacher_id, course_id, semester.
    """
    return _delete(school, changes, SECTION_KEY, ["tc", "sc"])


def _delete(
    school: School, changes: DataFrame, key: list[str], tables: Sequence[str]
) -> Outcome:
    """Remove the rows with the given keys from the first table and its dependants.

    A key counts only if the first table has it; that is looked up in the old
    snapshot, and the result drives every other table.
    """
    owner = getattr(school, tables[0])
    sound, faulty = _judge(_batch(changes), (_any_null(key), NO_SUCH_ROW))
    chosen = _winners(sound.select("change_seq", *key), key, "first")

    @cache
    def known() -> DataFrame:
        return _narrowed(owner, sound, key)

    @cache
    def gone() -> DataFrame:
        return stage(_matched(chosen.select(*key), known(), key), "gone", plain=True)

    def left() -> School:
        return school.with_tables(
            **{name: _unmatched(getattr(school, name), gone(), key) for name in tables}
        )

    def taken() -> DataFrame:
        parts = [_removed(name, _matched(getattr(school, name), gone(), key)) for name in tables]
        return _long_form(school, parts)

    return Outcome(
        left,
        lambda: _rejects(
            changes.columns,
            faulty,
            _marked(sound, known(), key, "_known"),
            key,
            chosen,
            (_absent("_known"), NO_SUCH_ROW),
        ),
        taken,
        (lambda: _semesters(gone())) if "semester" in key else None,
    )


# ---------------------------------------------------------------- enrolments and grades


def enrol(school: School, changes: DataFrame) -> Outcome:
    """Enrol students in sections, ungraded.

    changes: change_seq, student_username, teacher_id, course_id, semester. The
    section depends on the teacher, who is not part of the enrolment key, so it
    is looked up before one change per key is chosen.
    """
    batch = _as_delivered(
        _resolved(changes, school, "student_username", "student", "student_id"), light=False
    )
    sound, faulty = _judge(
        batch,
        (F.col("student_id").isNull(), UNKNOWN_USER),
        (_any_null(SECTION_KEY), NO_SUCH_ROW),
    )

    @cache
    def offered() -> DataFrame:
        return _known(school.tc, batch, sound, SECTION_KEY)

    def flagged(rows: DataFrame) -> DataFrame:
        rows = _marked(rows, offered(), SECTION_KEY, "_offered")
        return rows.withColumn("_unoffered", _absent("_offered")).drop("_offered")

    @cache
    def verdicts() -> DataFrame:
        # changes to sections that are offered come first
        return _verdicts(flagged(sound), ENROLMENT_KEY, school.sc, batch, ["_unoffered"])

    def offers() -> DataFrame:
        return verdicts().filter(~F.col("_first._unoffered"))

    def grown() -> School:
        added = (
            offers()
            .filter(_absent("_there"))
            .select(*ENROLMENT_KEY, "_first.teacher_id")
            .withColumn("score", F.lit(None).cast(school.sc.schema["score"].dataType))
            .select(*school.sc.columns)
        )
        return school.with_tables(sc=school.sc.unionByName(added))

    return Outcome(
        grown,
        lambda: _refused(
            changes.columns,
            faulty,
            sound,
            ENROLMENT_KEY,
            verdicts(),
            "first",
            (F.col("_unoffered"), NO_SUCH_ROW),
            (~_absent("_there"), DUPLICATE),
            flagged=flagged,
            unique=_named_once(school, "student"),
        ),
        semesters=lambda: _semesters(offers()),
    )


def drop(school: School, changes: DataFrame) -> Outcome:
    """Take students out of courses, graded or not.

    changes: change_seq, student_username, course_id, semester.
    """
    batch = _as_delivered(
        _resolved(changes, school, "student_username", "student", "student_id")
    )
    sound, faulty = _judge(
        batch,
        (F.col("student_id").isNull(), UNKNOWN_USER),
        (_any_null(ENROLMENT_KEY), NO_SUCH_ROW),
    )
    chosen = _winners(sound, ENROLMENT_KEY, "first")
    return Outcome(
        lambda: school.with_tables(sc=_unmatched(school.sc, chosen, ENROLMENT_KEY)),
        lambda: _refused(
            changes.columns,
            faulty,
            sound,
            ENROLMENT_KEY,
            _verdicts(sound, ENROLMENT_KEY, school.sc, batch),
            "first",
            (_absent("_there"), NO_SUCH_ROW),
            unique=_named_once(school, "student"),
        ),
        semesters=lambda: _semesters(chosen),
    )


def _set_scores(
    school: School,
    columns: Sequence[str],
    batch: DataFrame,
    sound: DataFrame,
    faulty: DataFrame,
    keep: str,
    score: Column,
    payload: Sequence[str] = (),
    named_once: Callable[[], bool] = lambda: True,
) -> Outcome:
    """Put ``score`` where a change names an enrolment together with its teacher.

    The changes shrink to one per enrolment and teacher before they meet sc, which
    is read and shuffled once.
    """
    chosen = _winners(sound.select("change_seq", *GRADED_KEY, *payload), GRADED_KEY, keep)
    news = chosen.select(*GRADED_KEY, F.lit(True).alias("_hit"), score.alias("_score"))
    sc = (
        school.sc.join(news, GRADED_KEY, "left")
        .withColumn("score", F.when(F.col("_hit"), F.col("_score")).otherwise(F.col("score")))
        .select(*school.sc.columns)
    )
    return Outcome(
        lambda: school.with_tables(sc=sc),
        lambda: _refused(
            columns,
            faulty,
            sound,
            GRADED_KEY,
            _verdicts(sound, GRADED_KEY, school.sc, batch),
            keep,
            (_absent("_there"), NO_SUCH_ROW),
            told_by=["change_seq", *payload],
            unique=named_once(),
        ),
        semesters=lambda: _semesters(chosen),
    )


def upsert_grades(
    school: School, changes: DataFrame, rules: GradeRules = DEFAULT_RULES
) -> Outcome:
    """Enter or update scores of a teacher's own students.

    changes: change_seq, teacher_username, student_id, course_id, semester, score
    (number or text).
    """
    batch = _clean(changes, ints=["score"])
    batch = _as_delivered(
        _resolved(batch, school, "teacher_username", "teacher", "teacher_id")
    )
    in_range = F.col("_new_score").between(rules.min_score, rules.max_score)
    sound, faulty = _judge(
        batch,
        (~F.coalesce(in_range, F.lit(False)), INVALID_VALUE),
        (F.col("teacher_id").isNull(), UNKNOWN_USER),
        (_any_null(ENROLMENT_KEY), NO_SUCH_ROW),
    )
    payload = [c for c in batch.columns if c not in GRADED_KEY and c != "change_seq"]
    return _set_scores(
        school,
        changes.columns,
        batch,
        sound,
        faulty,
        "last",
        F.col("_new_score"),
        payload,
        lambda: _named_once(school, "teacher"),
    )


def delete_grades(school: School, changes: DataFrame) -> Outcome:
    """Clear scores; the enrolment stays.

    changes: change_seq, teacher_id, student_id, course_id, semester.
    """
    batch = _as_delivered(changes)
    sound, faulty = _judge(batch, (_any_null(GRADED_KEY), NO_SUCH_ROW))
    empty = F.lit(None).cast(school.sc.schema["score"].dataType)
    return _set_scores(school, changes.columns, batch, sound, faulty, "first", empty)
