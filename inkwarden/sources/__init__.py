"""Sources of the inspection engine."""
