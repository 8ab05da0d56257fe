"""Spark-native toolkit for building and querying large text knowledge bases."""
