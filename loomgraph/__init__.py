"""Spark-native analytics over code graphs, workflow telemetry and text corpora."""
