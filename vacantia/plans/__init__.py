"""The engine's queries over the driver's tables."""

from vacantia.plans import analytics_queries, case_queries, discovery_queries, feed_queries, incremental_queries, operation_queries, relational_queries, rule_queries, scalar_queries, stream_queries, text_queries
from vacantia.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "analytics_queries", "case_queries", "discovery_queries", "feed_queries", "incremental_queries", "operation_queries", "relational_queries", "rule_queries", "scalar_queries", "stream_queries", "text_queries"]
