"""Job options and their validation."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from . import fixed_values as fv


def merge_mapping(overrides: Mapping[str, Sequence[str] | str] | None) -> dict[str, list[str]]:
    """Default field mapping with each overridden key replaced as a whole."""
    given = {str(name): _aliases(value) for name, value in (overrides or {}).items()}
    defaults = {name: list(value) for name, value in fv.JSON_FIELD_MAPPING.items()}
    return defaults | given


def _aliases(value: Sequence[str] | str) -> list[str]:
    """One alias or several; empty ones say nothing."""
    several = (value,) if isinstance(value, str) else value
    return list(filter(None, map(str, several)))


def check_format(fmt: str) -> str:
    lowered = fmt.lower()
    if lowered not in fv.SOURCE_FORMATS:
        raise ValueError(f"Unsupported format: {lowered}")
    return lowered


def path_list(value: str | Iterable[str] | None) -> list[str]:
    """Input paths from a list, the text of a JSON array, or text with one path per line or comma."""
    if isinstance(value, str):
        items: Iterable = _listed(value)
    elif value is None or isinstance(value, (list, tuple, set)):
        items = value or ()
    else:
        raise TypeError(f"input paths are a list or text, not {type(value).__name__}")
    return [path for path in (str(item).strip() for item in items) if path]


def _listed(text: str) -> list:
    if not text.lstrip().startswith("["):
        return re.split("[,\n]", text)
    found = json.loads(text)
    if not isinstance(found, list):
        raise TypeError("input paths in JSON are an array")
    return found


@dataclass(frozen=True)
class JobOptions:
    """What a job can be told; every field has the usual default."""

    model_type: str = "isolation_forest"
    anomaly_threshold: float = fv.ANOMALY_THRESHOLD
    baseline_threshold: float = fv.BASELINE_THRESHOLD
    min_threshold: float | None = None
    ingest_batch_size: int = fv.INGEST_BATCH_SIZE
    max_stored_anomalies: int = fv.MAX_STORED_ANOMALIES
    source_format: str = "jsonl"
    field_mapping: Mapping[str, Sequence[str] | str] = field(default_factory=dict)
    plain_patterns: Sequence[str] = field(default_factory=lambda: list(fv.PLAIN_PATTERNS))
    bootstrap_path: str | None = None
    input_paths: Sequence[str] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "source_format", check_format(self.source_format))
        object.__setattr__(self, "input_paths", tuple(path_list(self.input_paths)))
        if self.ingest_batch_size <= 0:
            raise ValueError("ingest_batch_size must be greater than zero")
