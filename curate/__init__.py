"""Curating labelled position and sequence datasets, and auditing models on them, with Spark."""

__version__ = "0.1.0"
