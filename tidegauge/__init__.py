"""Spark-native KPI analytics over telemetry of AI-agent runs."""
