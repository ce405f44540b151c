"""Part of the graph engine."""
