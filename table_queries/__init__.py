"""Queries over the driver's tables, each with its SQL where SQL can say it."""

from table_queries import analysis, collection, operations, planning, streams, table_joins, text  # noqa: F401
from table_queries.registry import QUERIES, SQL  # noqa: F401
