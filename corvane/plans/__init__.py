"""Query plans: operators applied to the tables."""
