"""Import every query module once."""

from suite import files, jobs, relational, textual, vectorial  # noqa: F401
from suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
