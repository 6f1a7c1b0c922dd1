"""Retrieval analytics on Spark: ingest, chunking, search, fusion, answering, quality and usage reports."""
