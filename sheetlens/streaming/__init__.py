"""Structured Streaming delivery of the batch and log operators."""
