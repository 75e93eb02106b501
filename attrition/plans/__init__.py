"""Composite jobs: the user-day feature plan, training, scoring, and the
query catalog."""
