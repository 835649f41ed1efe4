"""Query plans built from the operators, and their registry."""
