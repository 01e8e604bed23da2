"""Registered queries over the driver tables, each with the same in SQL."""
