"""All catalog queries."""

from __future__ import annotations

from . import content, desk, lists, similar, sound, star, tagging  # noqa: F401  (they register their queries)
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
