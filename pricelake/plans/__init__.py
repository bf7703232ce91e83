"""Every operator as a query over the tables, with the SQL that gives the same rows."""

from . import change_queries, column_queries, page_queries, search_queries, series_queries, stream_queries, table_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
