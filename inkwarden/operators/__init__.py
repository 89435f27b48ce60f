"""Operators of the inspection engine."""
