"""Spark-native routing and road-network analytics."""
