"""Every registered query by name, with its SQL."""

from __future__ import annotations

from galewatch.plans import archive_queries, extras, report_queries, round_queries, stream_queries  # noqa: F401 (they register their queries)
from galewatch.plans.radar_queries import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
