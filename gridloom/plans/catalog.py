"""All queries of this package by name, and SQL for DuckDB that gives the same rows."""

from gridloom.plans import graphs, modeling, parsing, placing, scenarios, scripting, telemetry  # noqa: F401
from gridloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
