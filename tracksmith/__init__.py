"""Spark-native trajectory analytics: GPS ingest, movement metrics, stops, dwell and fleet queries."""
