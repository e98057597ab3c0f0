"""Jobs that chain operators and stage intermediate tables."""
