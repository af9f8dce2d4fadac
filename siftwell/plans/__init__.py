"""Query plans that wire operators to tables."""
