"""Paragrove: Spark-first analytics over rule-typed technical documents."""

__version__ = "0.1.0"
