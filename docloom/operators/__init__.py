"""Relational operators of the corpus and of retrieval."""
