"""Queries over the given tables. Importing the package registers them."""

from tessella.plans import content_queries, markup_queries, number_queries, report_queries, resolution_queries, tree_queries  # noqa: F401
