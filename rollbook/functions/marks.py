"""Aggregate columns over scores and credits.

They are sums and counts of whole numbers with at most one division at the end,
so partial aggregation gives the same bits in whatever order rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.rules import GradeRules


def passed(rules: GradeRules, score: str = "score") -> Column:
    return F.count_if(F.col(score) >= rules.pass_mark)


def failed(rules: GradeRules, score: str = "score") -> Column:
    return F.count_if(F.col(score) < rules.pass_mark)


def earned_credits(rules: GradeRules, score: str = "score") -> Column:
    """Credits of the passed rows; 0 when none is passed."""
    return F.sum(F.when(F.col(score) >= rules.pass_mark, F.col("credits")).otherwise(0))


def gpa(rules: GradeRules, score: str = "score") -> Column:
    """Credit-weighted mean grade point of the graded rows; NULL without any."""
    mark = F.col(score)
    points = F.when(mark >= rules.pass_mark, (mark - rules.point_base) * F.col("credits")).otherwise(0)
    weight = F.when(mark.isNotNull(), F.col("credits") * rules.point_step)
    return ratio(F.sum(points), F.sum(weight))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as DOUBLE, NULL when there is nothing to divide by."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def or_zero(*columns: str) -> list[Column]:
    """Counts of an entity that matched no row."""
    return [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns]
