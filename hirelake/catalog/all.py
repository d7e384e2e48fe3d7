"""Importing this module registers every query."""

from . import (  # noqa: F401
    aggregate_queries,
    annotate_queries,
    board_queries,
    clean_queries,
    company_queries,
    diff_queries,
    filter_queries,
    search_queries,
    source_queries,
    stream_queries,
    trend_queries,
)
