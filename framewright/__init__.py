"""Spark-first analytics over media-like arrays, containers and corpora."""
