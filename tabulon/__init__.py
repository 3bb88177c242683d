"""Plan-driven analytics over tabular files on Spark."""
