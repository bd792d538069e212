"""Limits that can be set on the session as spark.lethe.*; each is a whole number of at least 0.

Operators take them from the session of their table unless they are passed one.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

from .fixed import DAY_PAGES, MAX_CHUNK, MAX_FILE, MAX_PAGES, MAX_TERM, MAX_TERMS, PER_DAY, PER_HOUR


@dataclass(frozen=True)
class Limits:
    max_file: int = MAX_FILE
    max_pages: int = MAX_PAGES
    max_terms: int = MAX_TERMS
    max_term: int = MAX_TERM
    max_chunk: int = MAX_CHUNK
    per_hour: int = PER_HOUR
    per_day: int = PER_DAY
    day_pages: int = DAY_PAGES

    @classmethod
    def of(cls, spark: SparkSession) -> Limits:
        values = {}
        for f in fields(cls):
            raw = spark.conf.get(f"spark.lethe.{f.name}", str(f.default))
            if not raw.isdigit():
                raise ValueError(f"spark.lethe.{f.name} must be a whole number of at least 0, not {raw!r}")
            values[f.name] = int(raw)
        return cls(**values)
