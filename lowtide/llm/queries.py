"""All queries of this subpackage."""

from lowtide.llm import (  # noqa: F401
    chat,
    chunk_dedup,
    language,
    line_dedup,
    link_trust,
    mixing,
    near_dedup,
    packing,
    periodic,
    quality,
    sharding,
    span_dedup,
    spelling,
)
from lowtide.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
