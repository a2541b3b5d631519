"""All registered queries; importing the modules registers them."""

from workload import health_queries, incident_queries, source_queries, store_queries, stream_queries, training_queries  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
