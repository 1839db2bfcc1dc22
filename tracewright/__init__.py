"""Tracewright: Spark-native analysis of structured application logs."""
