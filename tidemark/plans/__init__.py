"""Fixture views and the registered queries."""
