"""Rubric-deduction analytics as Spark DataFrame queries."""
