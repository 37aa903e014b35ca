"""Views of the test tables, and the registered queries with their SQL."""

from . import file_queries, queries  # noqa: F401
