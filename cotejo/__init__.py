"""Spark-native engine for price comparison and large-scale record processing."""
