"""All registered queries."""

from __future__ import annotations

import importlib

from sessionmill.plans.registry import CHECKS, QUERIES

for _module in ["usage_queries", "ledger_queries", "redaction_queries", "project_queries", "report_queries", "snapshot_queries", "run_queries", "file_queries"]:
    importlib.import_module(f"sessionmill.plans.{_module}")

__all__ = ["CHECKS", "QUERIES"]
