"""All registered queries; importing this module fills the registry."""

from cloudgauge.plans import capture_queries, cloud_queries, file_queries, fleet_queries, line_queries, model_queries, stereo_queries, stream_queries  # noqa: F401
from cloudgauge.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
