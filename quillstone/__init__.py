"""Spark-native bibliometric linkage and concentration analytics."""
