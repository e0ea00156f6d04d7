"""All queries over the driver tables and their SQL: importing a module registers its queries."""

from . import catalog, graph_queries, io_queries, ontology_queries, propagation_queries, search_queries, series_queries, structure_queries, view_queries  # noqa: F401

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
