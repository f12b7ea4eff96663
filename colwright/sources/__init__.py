"""Reading, writing and previewing tables."""
