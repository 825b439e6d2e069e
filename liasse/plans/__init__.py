"""Plans that compose the operators, and the registry of queries."""

from . import case_plan, check_queries, custody_queries, guard_queries, person_queries, piece_queries, stream_queries, text_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
