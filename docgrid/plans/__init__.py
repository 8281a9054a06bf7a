"""Queries with their SQL; importing the package registers all."""

from docgrid.plans import queries, page_queries, record_queries  # noqa: F401, I001
