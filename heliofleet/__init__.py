"""Sensor-series analytics as Spark DataFrame operators."""
