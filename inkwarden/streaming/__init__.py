"""Streaming of the inspection engine."""
