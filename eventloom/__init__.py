"""Spark-native event analytics: DataFrame operators for lakehouse tables, reports and retrieval."""
