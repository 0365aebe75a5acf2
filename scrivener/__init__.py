"""Transcript and candidate analytics on Spark."""
