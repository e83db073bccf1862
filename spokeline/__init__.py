"""Spark-native network routing and trajectory analytics."""
