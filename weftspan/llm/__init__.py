"""Operators for preparing training text; ``QUERIES`` and ``ORACLES`` are what the entry module adds."""

from weftspan.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
