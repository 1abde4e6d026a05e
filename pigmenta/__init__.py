"""Spark-native graph colouring: graphs as DataFrames, priority rules, first-fit colouring, partitions."""
