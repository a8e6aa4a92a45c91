"""Evaluation and dataset-quality analytics for speech and text tables on Spark."""

__version__ = "0.1.0"
