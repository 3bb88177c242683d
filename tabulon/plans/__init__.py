"""The query language: expressions, logical plans, validation and lowering to DataFrames."""
