"""Relational, classification, resolution, deduplication and roll-up operators."""
