"""Document-knowledge analytics on Spark: ingest, structure, concepts, graph, retrieval."""

__version__ = "0.1.0"
