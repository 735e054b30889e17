"""Spark-native analytics for LLM telemetry, evaluation runs and review queues."""
