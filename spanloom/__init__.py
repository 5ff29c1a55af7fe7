"""Spanloom: a telemetry store and query engine on Spark."""
