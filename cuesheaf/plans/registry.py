"""All queries of the library's own operators, and their SQL."""

from . import cue_queries, page_queries, run_queries, subtitle_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
