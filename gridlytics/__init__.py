"""Utility and credit analytics as PySpark DataFrame operators."""
