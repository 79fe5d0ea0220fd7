"""All queries of the graph engine and their SQL."""

from __future__ import annotations

from graphloom.plans import adapter_queries, control_queries, history_queries, policy_queries, record_queries, source_queries, task_queries, text_queries
from graphloom.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "adapter_queries", "control_queries", "history_queries", "policy_queries", "record_queries", "source_queries", "task_queries", "text_queries"]
