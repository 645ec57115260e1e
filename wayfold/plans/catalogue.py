"""All registered queries of the evidence operators, with their SQL."""

from __future__ import annotations

from . import curation_queries, evidence_queries, feed_queries, graph_queries, place_queries, record_queries, view_queries, work_queries, world_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401

FLAGSHIP = "claim_noisy_or"
