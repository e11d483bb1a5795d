"""Spark-native analytics for multi-tenant professional-practice data."""
