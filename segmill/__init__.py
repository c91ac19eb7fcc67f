"""Spark-native segmentation of text into tokens and sentences."""

__version__ = "0.2.0"
