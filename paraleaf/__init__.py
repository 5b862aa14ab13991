"""paraleaf: evaluation and preparation of page records on Spark."""

__version__ = "0.1.0"
