"""All registered queries of the engine and the SQL that each must agree with."""

from __future__ import annotations

from cairn.plans import consolidations, coordination, evaluation, flow, graph, lifecycle, memories, plane, planning, reports, reranking, retrieval, texts, upkeep

PLANS = (retrieval, flow, plane, planning, reranking, evaluation, graph, coordination, lifecycle, upkeep, texts, reports, consolidations, memories)
QUERIES = {name: query for plan in PLANS for name, query in plan.QUERIES.items()}
ORACLES = {name: sql for plan in PLANS for name, sql in plan.ORACLES.items()}
FLAGSHIP = "whole_recall"
