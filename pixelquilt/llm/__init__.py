"""Operators of a training-data pipeline over documents and pages, each with its registered query."""
