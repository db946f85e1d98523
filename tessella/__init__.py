"""Spark-native engine for spatial and single-cell omics tables."""

__version__ = "0.1.0"
