"""Passage indexing and batch retrieval over long texts, as Spark DataFrame operators."""
