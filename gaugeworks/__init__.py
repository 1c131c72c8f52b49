"""Sensor-network telemetry analytics on Spark."""
