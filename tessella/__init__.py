"""Spark-native analytics over timed, multilingual text segments."""
