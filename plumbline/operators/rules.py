"""Tolerances that a session may override, each within its bounds."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

#: The bounds of each tolerance.
BOUNDS = {"angle_degrees": (0.0, 15.0), "gap": (0.0, 100.0), "cover_share": (0.0, 1.0), "change_share": (0.0, 1.0)}


@dataclass(frozen=True)
class Rules:
    angle_degrees: float = 3.0
    gap: float = 6.0
    cover_share: float = 0.6
    change_share: float = 0.05

    def with_values(self, **values: float) -> Rules:
        for k, v in values.items():
            lo, hi = BOUNDS[k]
            if not lo <= v <= hi:
                raise ValueError(f"{k} must be from {lo} to {hi}")
        return replace(self, **values)

    @staticmethod
    def of(spark: SparkSession) -> Rules:
        """The rules with what the session's configuration says under plumbline.rules.*"""
        found = {f.name: spark.conf.get(f"plumbline.rules.{f.name}", None) for f in fields(Rules)}
        return Rules().with_values(**{k: float(v) for k, v in found.items() if v is not None})
