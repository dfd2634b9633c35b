"""Threat-intelligence text analytics as PySpark DataFrame jobs."""
