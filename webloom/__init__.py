"""Spark-native web change analytics: crawl facts, change history, delivery and scheduling as DataFrame programs."""

__version__ = "0.1.0"
