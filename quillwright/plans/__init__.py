"""Logical tables and the registration of queries on them."""
