"""Thresholds, with the defaults merged under a JSON file and checked."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    cross_path_boost: float = 0.15
    active_boost: float = 0.10
    automatable_boost: float = 0.05
    pattern_floor: float = 0.60
    proof_boost: float = 0.20
    cve_flag: float = 7.0
    epss_active: float = 0.5
    epss_poc: float = 0.1
    default_depth: int = 5
    max_depth: int = 6
    hub_callers: int = 50
    max_paths: int = 1000
    embedding_same: float = 0.95
    embedding_near: float = 0.85
    edit_same: float = 0.85
    gate3_max: int = 300
    triage_threshold: float = 0.5
    max_fan_in: int = 3
    tool_rows: int = 25

    def validate(self) -> Config:
        for f in fields(self):
            v = getattr(self, f.name)
            if f.type == "float" and f.name != "cve_flag" and not 0 <= v <= 1 or v < 0:
                raise ValueError(f"{f.name} is out of range: {v}")
        return self


def load(path: str | None = None) -> Config:
    """Defaults, overridden by the known keys of a JSON file."""
    if path is None:
        return Config().validate()
    with open(path) as f:
        got = json.load(f)
    return replace(Config(), **{k.name: got[k.name] for k in fields(Config) if k.name in got}).validate()
