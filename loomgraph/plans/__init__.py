"""Queries of the catalog operators. Importing this package registers them."""

from loomgraph.plans import catalog_queries, change_queries, component_queries, document_queries, edge_queries, graph_queries, session_queries, text_queries  # noqa: F401
