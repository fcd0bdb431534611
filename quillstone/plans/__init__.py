"""Registered queries over the driver tables."""

from quillstone.plans import registry  # noqa: F401
from quillstone.plans import edit_queries, graph_queries, markdown_queries, search_queries, table_queries, task_queries, tool_queries, view_queries  # noqa: F401
