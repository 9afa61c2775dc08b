"""Trajectory-forecast analytics as Spark DataFrame transformations."""
