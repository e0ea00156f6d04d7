"""A property-graph, ontology and sensor analytics engine written as Spark DataFrame plans."""
