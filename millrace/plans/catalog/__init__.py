"""All registered queries."""

from millrace.plans.catalog import checks, delivery, models, records, state, text  # noqa: F401
from millrace.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
