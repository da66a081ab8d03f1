"""Grainwise: contract-first tabular analytics on Spark DataFrames."""

from grainwise.contract import (
    DatasetContract,
    Domain,
    ForeignKey,
    Measure,
    Rule,
    Window,
)
from grainwise.registry import catalogue, run
from grainwise.scope import ScopedFrame, scope_for

__all__ = [
    "DatasetContract", "Domain", "ForeignKey", "Measure", "Rule", "Window",
    "ScopedFrame", "scope_for", "catalogue", "run",
]
