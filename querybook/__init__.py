"""Registered queries over the shared test tables, with their expected results as SQL."""
