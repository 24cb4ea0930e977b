"""Whole jobs composed of operators: retrieval and synthesis."""
