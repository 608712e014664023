"""School-record analytics as plain Spark DataFrame plans."""

from rollbook.rules import GradeRules
from rollbook.school import School

__all__ = ["GradeRules", "School"]
