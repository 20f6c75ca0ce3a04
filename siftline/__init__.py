"""Forensic-timeline analytics as plain Spark DataFrame jobs."""
