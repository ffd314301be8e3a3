"""Spark-native profiling, constraint discovery and encoding analytics."""
