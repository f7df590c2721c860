"""The library's queries over the test tables."""

from millrace.plans import market_queries, scalar_queries, series_queries, table_queries  # noqa: F401
from millrace.plans.registry import QUERIES, SQL  # noqa: F401
