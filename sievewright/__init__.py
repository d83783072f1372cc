"""Spark-native data preparation: lazy DataFrame operators with explicit keys, orders and types."""
