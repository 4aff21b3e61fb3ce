"""Spark-native analytics over serving telemetry, as DataFrame plans."""
