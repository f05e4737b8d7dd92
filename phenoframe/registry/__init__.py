"""All registered queries."""

from phenoframe.registry.base import ORACLES, QUERIES
from phenoframe.registry import evaluation, ingest, labelling, models, sampling, scenes, signals, sinks, statistics  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
