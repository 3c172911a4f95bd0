"""Spark jobs for curating, sampling, searching and scoring measurement data."""

__version__ = "0.1.0"
