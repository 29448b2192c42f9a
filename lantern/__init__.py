"""Batch and streaming jobs on Spark for the data behind a support assistant."""
