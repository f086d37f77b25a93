"""Composite jobs: each composes operators into one lazy plan with a single sink."""
