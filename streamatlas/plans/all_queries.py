"""All registered queries."""

from . import catalogue_queries, cycle_queries, page_queries, site_queries, stream_queries, url_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
