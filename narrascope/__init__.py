"""Spark-native analysis of large collections of short multilingual posts."""
