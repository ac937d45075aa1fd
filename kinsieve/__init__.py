"""Leakage-aware splits of sequence and text datasets on Spark."""

__version__ = "0.1.0"
