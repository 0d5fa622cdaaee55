"""Cluster job-trace analytics as Spark DataFrame transformations."""
