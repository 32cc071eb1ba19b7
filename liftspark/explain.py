"""Reports on decisions."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame

from .ops import decisions
from .types import schema_digest


def report(df: DataFrame) -> list[dict]:
    """One entry per function call in the frame's history: tier, reason, mode, layout, digest of what was read."""
    return [asdict(d) for d in decisions(df)]


def explain_udf(df: DataFrame) -> str:
    return json.dumps({"schema": schema_digest(df.schema), "functions": report(df)}, indent=2, sort_keys=True)


def counters(df: DataFrame) -> dict[str, int]:
    """How many calls took each tier, and how often each reason was given; no values of the data."""
    out: dict[str, int] = {}
    for d in decisions(df):
        for key in (f"tier.{d.tier}", f"reason.{d.reason}"):
            out[key] = out.get(key, 0) + 1
    return out
