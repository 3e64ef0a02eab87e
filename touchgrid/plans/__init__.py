"""Registered plans: views over the driver tables, queries and their SQL."""
