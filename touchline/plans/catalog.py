"""All registered queries of the match-tracking operators."""

from . import fold_queries, row_queries, source_queries, stream_queries, track_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
