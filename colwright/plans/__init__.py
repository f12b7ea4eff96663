"""Fitting, the operator registry and recipes."""
