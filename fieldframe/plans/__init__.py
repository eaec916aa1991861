"""Query plans: named jobs over the provided tables and their DuckDB oracle text."""

import importlib

from fieldframe.plans.registry import ORACLE, QUERIES

_MODULES = ["q_ensemble", "q_fields", "q_forcings", "q_compare", "q_samples", "q_jobs"]
for _m in _MODULES:
    importlib.import_module(f"fieldframe.plans.{_m}")

__all__ = ["QUERIES", "ORACLE"]
