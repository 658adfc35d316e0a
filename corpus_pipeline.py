"""A corpus pipeline of five stages; see tickloom.llm."""

from __future__ import annotations

from tickloom.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
