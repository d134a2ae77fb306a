"""Operators that prepare training text. ``QUERIES`` and ``ORACLES`` hold one query per operator."""

from webloom.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
