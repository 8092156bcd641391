"""Cohort and learning analytics as plain Spark DataFrame functions."""
