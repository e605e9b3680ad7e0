"""Retrieval and analytics over source-code corpora, as Spark plans."""
