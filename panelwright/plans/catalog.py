"""All registered queries; importing this module registers them."""

from panelwright.plans import (  # noqa: F401
    queries_chat,
    queries_feeds,
    queries_forecast,
    queries_panel,
    queries_reports,
)
from panelwright.plans.registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
