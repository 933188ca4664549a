"""Engagement analytics as PySpark DataFrame operators."""
