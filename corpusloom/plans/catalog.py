"""Every corpus query by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from corpusloom.plans import q_curate, q_sequences, q_stats, q_study, q_text
from corpusloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "q_curate", "q_sequences", "q_stats", "q_study", "q_text"]
