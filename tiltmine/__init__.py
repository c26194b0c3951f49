"""Spark-native circumstance mining: under which circumstances are measured events slow, and since when."""
