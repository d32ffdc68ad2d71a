"""Operator parameters in one place: defaults, changed by Spark settings (tessella.<name>) or environment variables (TESSELLA_<NAME>)."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

TRUE = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Settings:
    min_language_prob: float = 0.75
    min_avg_logprob: float = -1.1
    max_repetition_ratio: float = 0.25
    max_segment_seconds: float = 15.0
    refine_segments: int = 8
    skip_suspicious: bool = True
    skip_suspicious_ratio: float = 0.25
    translation_backend: str = "indictrans2"
    translation_chunk_chars: int = 800
    tts_chunk_chars: int = 80
    crossfade_ms: int = 50
    slowest_speed: float = 0.80
    fastest_speed: float = 1.25
    duration_tolerance: float = 0.06
    exact_fit: bool = True
    reference_seconds: float = 6.0
    temperature: float = 0.7
    temperature_boost: float = 0.08
    target_lang: str = "hi"

    @classmethod
    def load(cls, spark: SparkSession | None = None, **changes) -> Settings:
        """Defaults, then the environment, then Spark's settings, then changes; each text is read as the field's kind."""
        kinds = {"bool": lambda x: x.strip().lower() in TRUE, "int": int, "float": float, "str": str}
        values = {}
        for f in fields(cls):
            raw = os.environ.get(f"TESSELLA_{f.name.upper()}")
            raw = (spark.conf.get(f"tessella.{f.name}", None) if spark else None) or raw
            if raw is not None:
                values[f.name] = kinds[f.type](raw)
        return cls(**(values | changes))
