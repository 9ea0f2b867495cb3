"""Registered graph queries and their SQL."""

from __future__ import annotations

from graphweave.plans import calls, controls, exports, facts, findings, flows, graph, resolution, runtime, walks

QUERIES, SQL = {}, {}
for plans in (graph, findings, flows, resolution, exports, controls, calls, walks, runtime, facts):
    QUERIES |= plans.QUERIES
    SQL |= plans.SQL
