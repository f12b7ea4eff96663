"""Operators of a training-data pipeline: scans, scores, near copies, mixing, archives.

Nothing else in the library imports this subpackage; it may use the library's helpers.
"""
