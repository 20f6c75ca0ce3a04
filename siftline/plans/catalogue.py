"""Importing this module registers every query."""

from siftline.plans import (  # noqa: F401
    builder_queries, detection_queries, event_queries, function_queries, record_queries, report_queries, stream_queries,
)
from siftline.plans.registry import ORACLES, QUERIES  # noqa: F401
