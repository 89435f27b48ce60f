"""Functions of the inspection engine."""
