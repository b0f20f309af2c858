"""Settings; those named in ENVIRONMENT can be set by environment variables RETROSPARK_<NAME>."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    vector_weight: float = 0.7
    text_weight: float = 0.3
    specific_vector_weight: float = 0.25
    specific_text_weight: float = 0.75
    min_score: float = 0.42
    fuzzy_threshold: float = 0.70
    fuzzy_max_expansions: int = 5
    fuzzy_min_length: int = 4
    rare_docs: int = 10
    half_life_days: float = 30.0
    mmr_lambda: float = 0.7
    chunk_chars: int = 1500
    overlap_chars: int = 200
    dimensions: int = 1024
    metric: str = "l2"
    model: str = "hashing"
    provider: str = "hashing"
    base_url: str = "http://localhost:11434"
    instruction: str = ""

    @classmethod
    def from_environment(cls) -> Settings:
        kinds = {f.name: type(f.default) for f in fields(cls)}
        found = {n: os.environ.get(f"RETROSPARK_{n.upper()}") for n in ENVIRONMENT}
        return cls(**{n: kinds[n](v) for n, v in found.items() if v is not None})


ENVIRONMENT = ("min_score", "fuzzy_threshold", "fuzzy_max_expansions", "fuzzy_min_length", "specific_vector_weight", "specific_text_weight", "dimensions", "model", "provider", "base_url", "instruction")
