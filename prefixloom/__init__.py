"""Routing-registry analytics as Spark jobs."""
