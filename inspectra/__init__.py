"""Inspection data engine: DataFrame and Structured Streaming operators."""
