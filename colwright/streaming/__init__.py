"""Recipes on Structured Streaming tables."""
