"""Tabular and document analytics as Spark DataFrame operators."""
