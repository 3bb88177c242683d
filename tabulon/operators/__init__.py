"""Sampling, profiling and inference over datasets."""
