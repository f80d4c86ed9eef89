"""Spandrel: a Spark-native engine over code graphs, knowledge records and the text around them."""

__version__ = "0.1.0"
