"""Retrieval, graph expansion, evidence packing and provenance on Spark."""
