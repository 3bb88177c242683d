"""Scalar building blocks: text to value rules and the query language's functions."""
