"""Narrative analytics on Spark."""
