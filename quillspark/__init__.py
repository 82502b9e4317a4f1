"""Retrieval, evaluation and text processing over DataFrames."""
