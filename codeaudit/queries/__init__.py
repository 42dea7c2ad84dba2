"""Registered queries over the shipped tables, each with its SQL oracle where one exists."""

from codeaudit.queries.registry import ORACLES, QUERIES

from codeaudit.queries import (  # noqa: E402,F401
    q_ai, q_assurance, q_findings, q_fixes, q_graph, q_manifests, q_plans, q_provenance, q_reports, q_rules, q_sources, q_streaming,
)

__all__ = ["ORACLES", "QUERIES"]
