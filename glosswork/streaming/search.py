"""Search over a stream of pages: candidates are stateless; the best of each query and document is kept by update."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.search import progressive_candidates, scored, select_best


def candidates_stream(pages: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """pages is a streaming DataFrame, queries a static one; append mode."""
    return scored(progressive_candidates(pages, queries, **options))


def best_stream(pages: DataFrame, queries: DataFrame, **options) -> DataFrame:
    """The best so far; update or complete mode."""
    return select_best(candidates_stream(pages, queries, **options))
