"""tallyform: move messy tables into strict target schemas on Spark, and prove that no row was lost."""

from .operators.conform import Conformed, apply_rule, conform
from .operators.upsert import Upsert
from .plans.spec import FieldMapping, Plan, TargetField, TargetSpec

__all__ = ["Conformed", "FieldMapping", "Plan", "TargetField", "TargetSpec", "Upsert", "apply_rule", "conform"]
