"""Retrieval, ranking evaluation and context extraction as Spark plans."""
