"""Driver-side settings, read from a plain dictionary (for example a loaded YAML file)."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, Mapping

from logharbor.constants import DEFAULT_PATTERNS


class ConfigError(ValueError):
    """A setting has a value that no job can run with."""


@dataclass(frozen=True)
class ParserConfig:
    patterns: tuple[str, ...] = DEFAULT_PATTERNS
    timestamp_formats: tuple[str, ...] = ()
    unicode_classes: bool = True

    @classmethod
    def from_dict(cls, config: Mapping[str, Any]) -> "ParserConfig":
        if not isinstance(config, Mapping):
            raise ConfigError("configuration must be a mapping")
        entries = config.get("log_patterns", ())
        patterns = tuple(
            entry["pattern"]
            for entry in entries
            if isinstance(entry, Mapping) and "pattern" in entry
        )
        return cls(
            patterns=patterns,
            timestamp_formats=tuple(config.get("timestamp_formats", ())),
            unicode_classes=bool(config.get("unicode_classes", True)),
        )


ALGORITHMS = ("isolation_forest", "one_class_svm", "local_outlier_factor", "ensemble")


def check_contamination(value: Any) -> float | str:
    """``'auto'`` or a share strictly between 0 and 0.5."""
    if value == "auto":
        return "auto"
    try:
        share = float(value)
    except (TypeError, ValueError) as exc:
        raise ConfigError(f"invalid contamination: {value!r}") from exc
    if not 0.0 < share < 0.5:
        raise ConfigError(f"contamination must lie between 0 and 0.5, got {share}")
    return share


@dataclass(frozen=True)
class DetectorConfig:
    algorithm: str = "isolation_forest"
    contamination: float | str = 0.05
    n_estimators: int = 100
    max_samples: int | str = "auto"
    n_neighbors: int = 20
    n_components: int = 50
    max_features: int = 5000
    min_df: int = 2
    max_df: float = 0.95
    ngram_range: tuple[int, int] = (1, 2)
    use_pca: bool = True
    use_hashing: bool = False
    exact_neighbors: bool = True
    random_state: int = 42

    def __post_init__(self) -> None:
        object.__setattr__(self, "contamination", check_contamination(self.contamination))
        if self.algorithm not in ALGORITHMS:
            # An unknown algorithm falls back to the default one.
            object.__setattr__(self, "algorithm", "isolation_forest")

    @classmethod
    def from_dict(cls, config: Mapping[str, Any]) -> "DetectorConfig":
        section = dict(config.get("ml_model", {}))
        if "use_hashing_vectorizer" in section:
            section["use_hashing"] = section.pop("use_hashing_vectorizer")
        if "ngram_range" in section:
            section["ngram_range"] = tuple(section["ngram_range"])
        known = {k: v for k, v in section.items() if k in cls.__dataclass_fields__}
        return cls(**known)


@dataclass(frozen=True)
class AlertConfig:
    enabled: bool = True
    anomaly_threshold: int = 5
    time_window_minutes: int = 5
    throttle_minutes: int = 15
    source_name: str = "logharbor"
    extra_tags: tuple[str, ...] = field(default_factory=tuple)

    @classmethod
    def from_dict(cls, config: Mapping[str, Any]) -> "AlertConfig":
        section = config.get("alerting", {})
        known = {k: v for k, v in section.items() if k in cls.__dataclass_fields__}
        return cls(**known)
