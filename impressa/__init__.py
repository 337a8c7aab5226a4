"""Impression-log analytics on Spark."""
