"""Retrieval and impact analysis over a versioned corpus, expressed as Spark DataFrames."""
