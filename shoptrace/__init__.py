"""Retail event-log analytics as PySpark DataFrame operators."""
