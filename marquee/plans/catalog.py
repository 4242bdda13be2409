"""All queries over the driver's tables."""

from marquee.plans import (  # noqa: F401
    corpus_queries,
    function_queries,
    graph_queries,
    history_queries,
    search_queries,
    stream_queries,
)
from marquee.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
