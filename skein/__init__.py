"""Corpus, retrieval, conversation and event analytics as Spark jobs."""
