"""Corpus, retrieval and usage analytics as Spark jobs (DataFrame in, DataFrame out)."""
