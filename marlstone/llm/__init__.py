"""Operators of a training-data pipeline, expressed as Spark jobs."""
