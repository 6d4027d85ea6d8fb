"""Spark-native analytics for rivers seen from above: masks, networks, centerlines, migration."""

__version__ = "0.1.0"
