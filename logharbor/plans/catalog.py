"""All queries: importing this module fills the registry."""

from logharbor.plans import (  # noqa: F401
    detector_queries,
    feature_queries,
    parsing_queries,
    report_queries,
    service_queries,
    storage_queries,
    streaming_queries,
)
from logharbor.plans.registry import ORACLES, QUERIES  # noqa: F401
