"""Operators of a training-data pipeline, each with its queries and SQL in this folder."""
