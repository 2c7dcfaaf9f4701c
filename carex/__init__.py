"""Spark-first analytics over nested clinical documents."""

__version__ = "0.1.0"
