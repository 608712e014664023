"""Numbers and value sets the operators depend on, all of them overridable."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class GradeRules:
    """Grading and validation rules.

    A score counts as passed from ``pass_mark`` on. A passed score earns
    ``(score - point_base) / point_step`` grade points, a failed one none.
    """

    pass_mark: int = 60
    point_base: int = 50
    point_step: int = 10
    min_score: int = 0
    max_score: int = 100
    min_credits: int = 1
    max_credits: int = 10
    roles: tuple[str, ...] = ("student", "teacher", "admin")
    genders: tuple[str, ...] = ("男", "女")


DEFAULT_RULES = GradeRules()
