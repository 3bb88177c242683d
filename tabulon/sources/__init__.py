"""Datasets: delimited files of unknown dialect, Parquet tables, generated data."""
