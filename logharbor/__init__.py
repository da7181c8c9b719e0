"""Log analytics and anomaly detection as PySpark jobs."""

from logharbor.config import DetectorConfig, ParserConfig, AlertConfig
from logharbor.session import build_session, durable, shared_dir

__all__ = [
    "AlertConfig",
    "DetectorConfig",
    "ParserConfig",
    "build_session",
    "durable",
    "shared_dir",
]
