"""Windowed traffic analytics on Spark."""
