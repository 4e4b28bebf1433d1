"""Composite jobs: serving and the regeneration loop."""
