"""Derived tables, pipelines and registered queries."""

from lowtide.plans import (  # noqa: F401
    audio_queries,
    block_queries,
    catalogue_queries,
    channel_queries,
    curve_queries,
    document_queries,
    filter_queries,
    signal_queries,
    spectral_queries,
)
from lowtide.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
