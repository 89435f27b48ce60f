"""Plans of the inspection engine."""
