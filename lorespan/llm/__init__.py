"""Operators for preparing training data from large corpora, and the queries that apply them."""
